"""Quality rules with adaptive thresholds.

One pass over the texts counts words, symbols, capitals, repeated lines, words and windows. The
ratios of these counts go into quantile sketches per language and source: histograms over integer
buckets of 1/32 relative width, so sketches merge by adding and the merged one doesn't depend on
the order. Fences around a group's middle half replace fixed cutoffs; small groups borrow the
merged sketch of their language, or of all. The fences are joined back to the documents' counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import lean, materialise, table, tune

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: White space and bytes that begin no code point.
NOT_IN_WORDS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_twice")
#: Ratios (in thousandths, floored) whose fences decide: numerator, denominator, least spread, is
#: there a lower fence. The least spread keeps a group of copies, whose quartiles are equal, from
#: failing all that differ from them.
RATIOS = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 30, False),
    "upper": ("n_upper", "word_chars", 30, False),
    "dup_lines": ("n_dup_lines", "n_lines", 250, False),
    "repeats": ("n_repeat_words", "n_words", 150, False),
    "twice": ("n_twice", "n_words", 30, False),
}
#: Fences are this many spreads from the quartiles.
REACH = 3
#: Longer texts number their windows in arrays instead of a table of tuples.
LONG = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n < LONG:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) == n:
            return 0
        often = Counter(grams)
        hit = np.fromiter((often[g] > 1 for g in grams), bool, n)
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, gram, often = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = often[gram] > 1
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8."""
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), len(text) - without(NOT_IN_WORDS), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), without(UPPER), sum(map(bytes.__eq__, words, words[1:])),
    )


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of `docs` with a struct column `counts` (COUNTS, longs) in place of text_col."""
    tune(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.struct(*[F.col(c) for c in keep]).alias("row"))
    kind = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row")).schema
    kind = kind.add("counts", StructType([StructField(c, LongType()) for c in COUNTS]))

    def run(batches):
        for batch in batches:
            got = np.array([text_counts(t.as_py()) for t in batch.column(0)], np.int64).reshape(-1, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(1), counts], names=["row", "counts"])

    return rows.mapInArrow(lean(run), kind)


def bucket(v: Column) -> Column:
    """Least value of the sketch's bucket of a whole number: its first six binary digits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def ratio(name: str, counts: Column) -> Column:
    over, under, _, _ = RATIOS[name]
    return F.when(counts[under] > 0, F.call_function("div", F.lit(1000) * counts[over], counts[under])).otherwise(F.lit(0)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, name of the ratio, bucket, n (rows of `lang`, `source`,
    `counts`). Texts without words have no ratios. Partial sums keep hot groups small."""
    each = rows.where(F.col("counts")["n_words"] > 0).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("name"), bucket(ratio(r, F.col("counts"))).alias("bucket")) for r in RATIOS])).alias("x")
    )
    return each.groupBy("lang", "source", "x.name", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The merged sketches of the keys, read at 1/4 and 3/4: keys, name, size, q1, q3 (buckets).

    A window sees one merged sketch: at most 32 buckets a power of two.
    """
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "name")
    ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("size", F.sum("n").over(own))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("size"), F.col("bucket")))
    return ranked.groupBy(*keys, "name").agg(F.first("size").alias("size"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, least: int = 200) -> DataFrame:
    """lang, source and `fence`: by ratio's name the lowest and highest value that passes.

    A group of under `least` documents with words takes the fences of its language, and such a
    language those of all documents.
    """
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select("lang", "name", *[F.col(c).alias(f"l_{c}") for c in ("size", "q1", "q3")])
    every = quartiles(sketch, []).select("name", *[F.col(c).alias(f"a_{c}") for c in ("q1", "q3")])
    pick = lambda q: F.when(F.col("size") >= least, F.col(q)).when(F.col("l_size") >= least, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    spreads = F.create_map(*[F.lit(x) for r, (_, _, s, _) in RATIOS.items() for x in (r, s)])
    lower = F.col("name").isin([r for r, (*_, low) in RATIOS.items() if low])
    spread = F.greatest(F.col("q3") - F.col("q1"), spreads[F.col("name")])
    return (
        own.join(lang, ["lang", "name"])
        .join(F.broadcast(every), "name")  # a row a ratio
        .select("lang", "source", "name", pick("q1").alias("q1"), pick("q3").alias("q3"))
        .select("lang", "source", "name", F.when(lower, F.col("q1") - REACH * spread).otherwise(F.lit(0)).alias("low"), (F.col("q3") + REACH * spread).alias("high"))
        .groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("low", "high")))).alias("fence"))  # an entry a ratio
    )


def with_fences(rows: DataFrame, limits: DataFrame, max_broadcast: int = 100_000, salts: int = 64) -> DataFrame:
    """`rows` with the fence of their lang and source: broadcast if at most max_broadcast groups
    (the written table is counted), else a join in which each group is dealt over the salts."""
    if limits.count() <= max_broadcast:
        return rows.join(F.broadcast(limits), ["lang", "source"], "left")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    every = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, ["lang", "source", "salt"], "left").drop("salt")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 200, max_broadcast: int = 100_000) -> DataFrame:
    """One row per row of `docs`: a struct `row` of its columns but the text, a struct `counts`
    (COUNTS), base_failed (under 50 words, or over half of them in repeated three-word windows),
    `failed` (names of the ratios outside their fences, sorted) and kept.

    Null texts count as empty: no words, base_failed. A null lang or source is a group with the
    empty string. Whole texts count, however long; repeated rows count each and get equal results;
    a value on a fence passes. An empty table gives no rows; clashing names don't matter.
    """
    rows = materialise(counted(docs, text_col), "quality-counts")
    null = lambda c: F.coalesce(F.col("row")[c].cast("string"), F.lit(""))
    rows = rows.select("row", "counts", null(lang_col).alias("lang"), null(source_col).alias("source"))
    limits = materialise(fences(sketches(rows), least), "quality-fences")
    c, fence = F.col("counts"), F.col("fence")
    outside = [F.when((ratio(r, c) < fence[r]["low"]) | (ratio(r, c) > fence[r]["high"]), F.lit(r)) for r in sorted(RATIOS)]
    base = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    failed = F.array_compact(F.array(*outside))
    return with_fences(rows, limits, max_broadcast).select("row", "counts", base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))


def op13_quality_rules(spark, sf_dir):
    """The rules over `documents`, thresholds by lang and source; edge cases as quality_rules() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    c = F.col("counts")
    return quality_rules(docs).select("row.doc_id", *[c[x].alias(x) for x in COUNTS[:5]], "base_failed", "kept")


_COUNT = "(length({0}) - length(regexp_replace({0}, '{1}', '', 'g')))"
_RATIO = {r: f"CASE WHEN {u} > 0 THEN (1000 * {o}) // {u} ELSE 0 END" for r, (o, u, _, _) in RATIOS.items()}
SQL = rf"""
WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
word AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM raw),
gram AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM word, unnest(range(1, len(w) - 1)) AS u(i)),
often AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM gram),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM often, unnest([i, i + 1, i + 2]) AS u(p) WHERE n > 1 GROUP BY rid),
twin AS (SELECT rid, count(*) AS n_twice FROM word, unnest(range(1, len(w))) AS u(i) WHERE w[i] = w[i + 1] GROUP BY rid),
line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM word, unnest(string_split(t, chr(10))) AS u(l)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
cnt AS (
  SELECT rid, doc_id, lang, source, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
         {_COUNT.format("t", "[#*$%&|<>]")}::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(n_lines, 0)::bigint AS n_lines,
         {_COUNT.format("t", "[A-Z]")}::bigint AS n_upper, coalesce(n_twice, 0)::bigint AS n_twice
  FROM word LEFT JOIN rep USING (rid) LEFT JOIN twin USING (rid) LEFT JOIN line USING (rid)
),
val AS ({" UNION ALL ".join(f"SELECT rid, lang, source, n_words, '{r}' AS name, {x} AS v FROM cnt" for r, x in _RATIO.items())}),
sketch AS (
  SELECT lang, source, name, (v // (2 ** greatest(length(bin(v)) - 6, 0))::bigint) * (2 ** greatest(length(bin(v)) - 6, 0))::bigint AS bucket, count(*) AS n
  FROM val WHERE n_words > 0 GROUP BY ALL
),
lv AS (
  SELECT 0 AS level, lang, source, name, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, '', name, bucket, sum(n) FROM sketch GROUP BY lang, name, bucket
  UNION ALL SELECT 2, '', '', name, bucket, sum(n) FROM sketch GROUP BY name, bucket
),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, name) AS size FROM lv
),
q AS (
  SELECT level, lang, source, name, max(size) AS size, min(bucket) FILTER (WHERE 4 * upto >= size) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * size) AS q3
  FROM cum GROUP BY level, lang, source, name
),
quart AS (
  SELECT o.lang, o.source, o.name,
         CASE WHEN o.size >= 200 THEN o.q1 WHEN l.size >= 200 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.size >= 200 THEN o.q3 WHEN l.size >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM q o JOIN q l ON l.level = 1 AND l.lang = o.lang AND l.name = o.name JOIN q a ON a.level = 2 AND a.name = o.name WHERE o.level = 0
),
least(name, spread, has_low) AS (VALUES {", ".join(f"('{r}', {s}, {str(low).lower()})" for r, (_, _, s, low) in RATIOS.items())}),
fence AS (
  SELECT lang, source, name, CASE WHEN has_low THEN q1 - {REACH} * greatest(q3 - q1, spread) ELSE 0 END AS low, q3 + {REACH} * greatest(q3 - q1, spread) AS high
  FROM quart JOIN least USING (name)
),
bad AS (SELECT DISTINCT rid FROM val JOIN fence USING (lang, source, name) WHERE v < low OR v > high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM cnt
"""
