"""Benchmark decontamination: one Aho-Corasick automaton over the words of all items.

Texts and items are folded (A-Z to a-z) and cut into words; an item's windows of `window`
consecutive words (an item of fewer words is one window) are the automaton's patterns over
word numbers. Each text is scanned once, and matched word ranges are mapped back to
character offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialise, once_a_worker, table, tune, utf8

#: ASCII bytes that are no letter or digit end a word; A-Z become a-z; other bytes stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def build(items: list[tuple[str, bytes]], window: int):
    """Automaton, word numbers and least pattern length of (id, text) items."""
    import ahocorasick

    number: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[int]] = {}
    for k, (_, text) in enumerate(items):
        ids = tuple(number.setdefault(w, len(number) + 1) for w in item_words(text))
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            patterns.setdefault(ids[i : i + window], set()).add(k)
    if not patterns:
        return None, number, 0
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for ids, of in patterns.items():
        automaton.add_word(ids, (len(ids), of))
    automaton.make_automaton()
    return automaton, number, min(map(len, patterns))


def scan(text: bytes, automaton, number: dict, least: int) -> tuple[int, list[list[int]], set[int]]:
    """Number of words, merged ranges of hit words, and the items that occur."""
    words = text.translate(FOLD).split()
    spans: list[list[int]] = []
    found: set[int] = set()
    known = bytes(map(number.__contains__, words))
    if automaton is None or b"\1" * least not in known:
        return len(words), spans, found
    ends: dict[int, int] = {}  # end of a match to its first word, the longest match
    for end, (n, of) in automaton.iter(tuple(number.get(w, 0) for w in words)):
        found |= of
        ends[end] = min(ends.get(end, end), end - n + 1)
    for end in sorted(ends, key=lambda e: ends[e]):
        if spans and ends[end] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end + 1)
        else:
            spans.append([ends[end], end + 1])
    return len(words), spans, found


def char_offsets(text: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) in characters of the original text."""
    at = [m.span() for m in WORD.finditer(text)] if spans else []
    return [(len(text[: at[a][0]].decode()), len(text[: at[b - 1][1]].decode())) for a, b in spans]


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of blocks of about block_bytes, and their items, a block at a time: the driver
    holds no more than one. Each block becomes one automaton."""
    rows = bench.select(F.col(id_col).cast("string").alias("i"), utf8(F.col(text_col)).alias("t")).where("i is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("i"), F.lit(n))
    return n, ([(r["i"], bytes(r["t"])) for r in rows.where(part == k).orderBy("i", "t").toLocalIterator()] for k in range(n))


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
    out_col: str = "hits",
) -> DataFrame:
    """Rows of `docs` with a struct column out_col added; `docs` must not have it yet.

    out_col: n_words, n_hit (words inside any occurrence of a window), items (ids as strings,
    sorted, of items with an occurring window), spans (start, end: characters of the
    original text, merged).

    The items are cut into blocks of about block_bytes, each scanned by an automaton of its own.
    Of several blocks one after the other is collected, broadcast, scanned for and dropped, its
    hits written, so that driver and tasks hold one block however large the benchmark is. Null and
    empty texts have no words; items without words or id match nothing; repeated items
    count by id; rows and other columns pass unchanged; empty tables give empty results.
    """
    if out_col in docs.columns:
        raise ValueError(f"docs has a column {out_col}; name another out_col")
    spark = docs.sparkSession
    tune(spark)
    out = docs.withColumn(
        out_col, F.lit(None).cast("struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:int,end:int>>>")
    )
    n, blocks = _blocks(bench, item_id_col, item_text_col, block_bytes)
    for k, block in enumerate(blocks):
        shared, before = spark.sparkContext.broadcast(block), out
        del block
        out = _pass(out, text_col, shared, window)
        if n > 1:
            out = materialise(out, "decontaminate")
            shared.destroy()
            if k:
                discard(before)
    return out


def _pass(docs: DataFrame, text_col: str, block, window: int) -> DataFrame:
    schema, key = docs.schema, uuid.uuid4().hex
    at = docs.columns.index(text_col)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        items = block.value
        automaton, number, least = once_a_worker(key, lambda: build(items, window))
        ids = [i for i, _ in items]
        for batch in batches:
            hits = []
            for text, before in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                raw = (text.as_py() or "").encode()
                n, spans, found = scan(raw, automaton, number, least)
                row = {"n_words": n, "n_hit": sum(b - a for a, b in spans), "items": sorted({ids[k] for k in found})}
                row["spans"] = [{"start": a, "end": b} for a, b in char_offsets(raw, spans)]
                if (old := before.as_py()) is not None:
                    row = _merged(old, row, raw)
                hits.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], names=batch.schema.names)

    return docs.mapInArrow(lean(run), schema)


def _merged(a: dict, b: dict, raw: bytes) -> dict:
    """Hits of two blocks: spans united, hit words counted anew."""
    spans: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in a["spans"] + b["spans"]):
        if spans and s[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s[1])
        else:
            spans.append(list(s))
    text = raw.decode()
    hit = sum(len(item_words(text[x:y].encode())) for x, y in spans)
    return {"n_words": b["n_words"], "n_hit": hit, "items": sorted({*a["items"], *b["items"]}), "spans": [{"start": x, "end": y} for x, y in spans]}


def op10_decontaminate(spark, sf_dir):
    """Hits of ten-word windows of `benchmark` in `documents`; edge cases as decontaminate() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(i)
),
hit AS (SELECT doc_id, i, n, item_id FROM gram JOIN win USING (n, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY 1
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM hit) GROUP BY 1
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
