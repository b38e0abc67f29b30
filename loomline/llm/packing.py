"""Packing of token sequences into length buckets of least padding.

The histogram of lengths over all documents goes to a dynamic programme that chooses the
bucket boundaries; each bucket is then cut into batches of at most a token budget.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def best_boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """At most `buckets` boundaries, each a length that occurs, that minimise padding.

    histogram: (length, rows) pairs. A row is padded to the least boundary that holds it.
    Exact: dp[k][j], the least padding of the first j lengths in k buckets, is a minimum
    over lines in the boundary's length, found with a monotone hull in O(k * lengths).
    No rows: no boundaries. Of equal choices the one of fewest buckets is taken.
    """
    h = sorted((n, c) for n, c in histogram if c)
    if not h:
        return []
    rows, tokens = [0], [0]
    for n, c in h:
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + n * c)
    m, inf = len(h), float("inf")
    before: list = [0] + [inf] * m
    choice: list[list[int]] = []
    costs = []
    for _ in range(min(buckets, m)):
        now, came = [inf] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, place
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if before[i] < inf:
                line = (-rows[i], before[i] + tokens[i], i)
                while len(hull) - head >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if len(hull) <= head:
                continue
            n = h[j - 1][0]
            while len(hull) - head >= 2 and hull[head + 1][0] * n + hull[head + 1][1] <= hull[head][0] * n + hull[head][1]:
                head += 1
            a, b, came[j] = hull[head]
            now[j] = a * n + b + n * rows[j] - tokens[j]
        choice.append(came)
        costs.append(now[m])
        before = now
    k = costs.index(min(costs))
    out, j = [], m
    while j:
        out.append(h[j - 1][0])
        j, k = choice[k][j], k - 1
    return out[::-1]


def words_and_end(text: Column) -> Column:
    """Length of a text in tokens: its words, and one end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    max_tokens: int = 4096,
    buckets: int = 16,
    budget: int = 65_536,
    shard_rows: int = 50_000,
    text_out: str | None = None,
) -> DataFrame:
    """Assign each document's sequences to batches; one row per sequence.

    length: a column of token counts; by default words plus one end (words_and_end).
    Documents of more than max_tokens tokens are cut into consecutive sequences of that
    length, so whole documents are packed. Columns: id_col, sequence (from 0), start (its
    first token), n_tokens, bucket_tokens (length padded to), batch (from 0 in a bucket),
    slot (place in the batch), padding. A batch's rows times bucket_tokens is at most
    `budget` (at least one row); only the last batch of a bucket may be less than full.

    text_out: name of a further column with each sequence's own text: its words, with the white
    space before them, and in the last sequence that after the last word; a document's
    sequences, joined, are its text. It needs the default length.

    Rows are numbered in shards of about shard_rows rows, then shifted by the shards'
    offsets, so no task sees a whole bucket. Null or negative lengths count as 0; a
    document of length 0 is one empty sequence. Null texts are empty. Repeated rows, ids
    and ties are packed each by itself. An empty table gives no rows; other columns are
    not read.
    """
    if budget < 1 or max_tokens < 1 or buckets < 1:
        raise ValueError("max_tokens, buckets and budget must be positive")
    n = words_and_end(F.col(text_col)) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    if text_out is not None and length is not None:
        raise ValueError("text_out needs tokens that are words: leave out length")
    last = F.greatest(F.ceil(F.col("_n") / F.lit(max_tokens)) - 1, F.lit(0)).cast("int")
    if text_out is None:
        seq = docs.select(F.col(id_col).alias("_id"), n.alias("_n")).withColumn("_q", F.explode(F.sequence(F.lit(0), last)))
    else:
        text = F.coalesce(F.col(text_col), F.lit(""))
        parts = docs.select(F.col(id_col).alias("_id"), n.alias("_n"), F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0)).alias("_w"), F.regexp_extract(text, f"{SPACE}*$", 0).alias("_tail"))
        cut = lambda q: F.struct(q.alias("q"), F.concat(F.array_join(F.slice("_w", q * max_tokens + 1, F.lit(max_tokens)), ""), F.when(q == last, F.col("_tail")).otherwise("")).alias("t"))
        seq = parts.select("_id", "_n", F.explode(F.transform(F.sequence(F.lit(0), last), cut)).alias("_x")).select("_id", "_n", F.col("_x.q").alias("_q"), F.col("_x.t").alias("_text"))
    own_text = [] if text_out is None else ["_text"]
    seq = seq.select("_id", "_q", F.least(F.col("_n") - F.col("_q") * F.lit(max_tokens), F.lit(max_tokens)).cast("int").alias("_len"), *own_text)
    # Written with a number of its own for each row, so that repeated ids are dealt out too.
    seq = materialise(seq.withColumn("_row", F.monotonically_increasing_id()), "packing-lengths")

    histogram = [(r["_len"], r["n"]) for r in seq.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()]  # max_tokens + 1 at most
    bounds = best_boundaries(histogram, buckets)
    sizes = [sum(c for x, c in histogram if low < x <= high) for low, high in zip([-1, *bounds], bounds, strict=False)]

    def by_bucket(values):
        if not bounds:
            return F.lit(0)
        rest = F.lit(values[-1])
        return reduce(lambda tail, bv: F.when(F.col("_len") <= bv[0], F.lit(bv[1])).otherwise(tail), list(zip(bounds, values, strict=True))[-2::-1], rest)

    rows = seq.select(
        "*",
        by_bucket(bounds).alias("_bound"),
        by_bucket([max(1, budget // max(1, b)) for b in bounds]).alias("_per"),
        F.pmod(F.xxhash64("_row"), by_bucket([-(-s // shard_rows) for s in sizes]).cast("long") if bounds else F.lit(1)).alias("_shard"),
    )
    shards = rows.groupBy("_bound", "_shard").agg(F.count(F.lit(1)).alias("_c"))
    offsets = shards.select(
        "_bound", "_shard", (F.sum("_c").over(Window.partitionBy("_bound").orderBy("_shard")) - F.col("_c")).alias("_off")
    )
    own = Window.partitionBy("_bound", "_shard").orderBy("_len", "_id", "_q", "_row")
    at = F.col("_off") + F.col("_rn")
    return (
        rows.withColumn("_rn", F.row_number().over(own) - 1)
        .join(offsets, ["_bound", "_shard"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_q").alias("sequence"),
            (F.col("_q").cast("long") * F.lit(max_tokens)).alias("start"),
            F.col("_len").alias("n_tokens"),
            F.col("_bound").alias("bucket_tokens"),
            F.floor(at / F.col("_per")).cast("long").alias("batch"),
            (at % F.col("_per")).cast("int").alias("slot"),
            (F.col("_bound") - F.col("_len")).alias("padding"),
            *[F.col("_text").alias(text_out) for _ in own_text],
        )
    )


def op6_packing(spark, sf_dir):
    """Sequences of `documents` in buckets and batches; edge cases as pack() says."""
    return pack(table(spark, sf_dir, "documents"))
