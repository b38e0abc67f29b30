"""Filter interaction audit: what every order of five filters keeps, removes and loses.

Rows are range-sorted by text fingerprint, whole text and doc_id, so that a text's copies stand
one after another and even a huge group is cut over many partitions. Each row is compared with
its predecessor; runs at the edge of a partition are settled by a table of edge runs. Each row's
failures are a mask of five bits, the masks are counted by part, and all figures of the 120
orders follow from those counts by sums.
"""

from __future__ import annotations

import itertools
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, table, tune

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Bytes that begin no code point.
INNER = bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, UPPER))) > 10 * len(text.translate(None, INNER))
    odd = any(s in text for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    return few + 2 * same + 4 * loud + 8 * odd


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per run of equal (id, part, mask): id, part, mask (bits in the order of FILTERS), n.

    Null texts count as empty and a null part as the empty string. A copy (filter E) has a row of
    the same text and a smaller id anywhere in the table; rows with a null id are no copies and
    make none, and of rows tied on id and text none is the smaller. Very long texts are one value
    of a sort, never cut. An empty table gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("fp"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"),
    )
    # The ranges' keys are narrow, and `at` lets even repeated ids of one text be cut.
    ranged = rows.repartitionByRange("fp", "id", "at").sortWithinPartitions("fp", "text", "id")
    kind = docs.schema[id_col].dataType.simpleString()
    found = ranged.select("fp", "id", "part", "text").mapInArrow(lean(_compare), f"id {kind}, part string, mask int, n long, edge string")
    found = materialise(found, "filter-masks")
    # Runs at edges: at most a first and a last fingerprint of each partition.
    least = found.where("edge is not null").groupBy("edge").agg(F.min("id").alias("least"))
    return found.join(F.broadcast(least), "edge", "left").select(
        "id", "part", F.when(F.col("least") < F.col("id"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"), "n"
    )


def _compare(batches):
    """Masks of sorted rows. A run's least id can still be a copy of a row in another partition if
    the run has the first or last fingerprint: such rows carry the text's sha256 as `edge`."""
    import numpy as np

    kind, out = None, {k: [] for k in ("id", "part", "mask", "n", "edge")}
    first_fp = fp = text = least = mask = edge = None
    held: dict[tuple, int] = {}  # rows of the current fingerprint that may be settled by other partitions

    def put(i, part, m, n, e):
        for k, v in zip(out, (i, part, m, n, e), strict=True):
            out[k].append(v)

    def flush():
        made = pa.RecordBatch.from_arrays(
            [pa.array(out["id"], kind), pa.array(out["part"], pa.string()), pa.array(out["mask"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["edge"], pa.string())],
            names=list(out),
        )
        for v in out.values():
            v.clear()
        return made

    for batch in batches:
        kind = batch.schema.field(1).type
        fps, ids, parts, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        same = np.zeros(len(fps), bool)  # equal to its predecessor in the batch
        if len(fps) > 1:
            same[1:] = fps[1:] == fps[:-1]
            for k in np.flatnonzero(same):
                same[k] = texts[k].as_buffer() == texts[k - 1].as_buffer() if len(texts[k].as_buffer()) == len(texts[k - 1].as_buffer()) else False
        for k in range(len(fps)):
            if not same[k]:
                new = texts[k].as_py()
                if fp is None or int(fps[k]) != fp or new != text:
                    if fp is not None and int(fps[k]) != fp:
                        edged = fp == first_fp
                        for (i, part, m, e), n in held.items():
                            put(i, part, m, n, e if edged else None)
                        held.clear()
                    fp, text, least, mask, edge = int(fps[k]), new, None, text_mask(new), None
                    first_fp = fp if first_fp is None else first_fp
            i = ids[k]
            if i is None:
                put(i, parts[k], mask, 1, None)
            elif least is None or i == least:
                least = i
                edge = edge or sha256(text).hexdigest()
                held[i, parts[k], mask, edge] = held.get((i, parts[k], mask, edge), 0) + 1
            else:
                put(i, parts[k], mask | COPY, 1, None)
        yield flush()
    if kind is not None:
        for (i, part, m, e), n in held.items():
            put(i, part, m, n, e)
        yield flush()


def part_counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counters by part and mask: n, good, toxic.

    A document is good or toxic if any label row of its id says so; null labels and ids say
    nothing. Rows of equal id are summed before they meet the labels, so a repeated id is few rows.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("g"), F.max(F.col("toxic") == 1).alias("t"))
    few = rows.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    yes = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return few.join(known, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), yes("g").alias("good"), yes("t").alias("toxic"))


def orders(spark) -> DataFrame:
    """The fixed table of all orders: filter_order, step, mask and what a row of that mask is there."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            bit, before = 1 << f, sum(1 << x for x in order[: step - 1])
            for m in range(1 << len(FILTERS)):
                removed = bool(m & bit) and not m & before
                # Among a row's failures each comes first in equally many orders.
                share = 120 // m.bit_count() if m & bit else 0
                out.append((name, step, m, int(not m & (before | bit)), int(removed), int(bool(m & bit and m & before)), int(m == bit), share))
    return spark.createDataFrame(out, "filter_order string, step int, mask int, kept int, removed int, redundant int, only int, share int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter order and step (its filter is the order's letter of that place).

    Counts within the part: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (rows its filter removes, summed over all orders). Filters, nulls, ties, repeated rows
    and copies as text_mask() and masks() say; labels as part_counters() says. Every part that has
    a row has all 600 rows, zeros included; an empty table gives none. Clashing names don't matter.
    """
    counts = part_counters(masks(docs, id_col, text_col, part_col), labels)
    total = lambda flag, of="n": F.sum(F.col(flag) * F.col(of)).cast("long")
    return (
        counts.join(F.broadcast(orders(docs.sparkSession)), "mask")  # 19,200 fixed rows
        .groupBy("part", "filter_order", "step")
        .agg(
            total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("only").alias("unique_fails"),
            total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("share").alias("shapley"),
        )
    )


def op12_filter_audit(spark, sf_dir):
    """The audit of `documents` by lang, with `labels`; edge cases as audit() says."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH raw AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
doc AS (
  SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS least,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM raw
),
lab AS (SELECT doc_id, max((quality = 1)::int) AS g, max((toxic = 1)::int) AS x FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x,
         (len(w) < 100)::int AS a,
         (100 * len(list_distinct(w)) < 80 * len(w))::int AS b,
         (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int AS c,
         regexp_matches(t, '[#$%&*|]')::int AS d,
         coalesce(doc_id > least, false)::int AS e
  FROM doc LEFT JOIN lab USING (doc_id)
),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(g) AS g, sum(x) AS x FROM fails GROUP BY ALL),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
perms AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.f <> q.f AND p.f <> r.f AND p.f <> s.f AND p.f <> t.f AND q.f <> r.f AND q.f <> s.f AND q.f <> t.f
    AND r.f <> s.f AND r.f <> t.f AND s.f <> t.f
),
steps AS (SELECT filter_order, step::int AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier FROM perms, range(1, 6) AS u(step)),
said AS (SELECT *, substr('A', 1, a) || substr('B', 1, b) || substr('C', 1, c) || substr('D', 1, d) || substr('E', 1, e) AS failed FROM cells),
hit AS (
  SELECT part, filter_order, step, f, failed, n, g, x, contains(failed, f) AS own,
         length(regexp_replace(failed, '[' || earlier || '0]', '', 'g')) < length(failed) AS before
  FROM said, steps
),
outcome AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (WHERE NOT own AND NOT before) AS kept, sum(n) FILTER (WHERE own AND NOT before) AS removed,
         sum(n) FILTER (WHERE own AND before) AS redundant, sum(n) FILTER (WHERE failed = f) AS unique_fails,
         sum(g) FILTER (WHERE own AND NOT before) AS good_lost, sum(x) FILTER (WHERE own AND NOT before) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
       coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
       coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::bigint AS shapley
FROM outcome
"""
