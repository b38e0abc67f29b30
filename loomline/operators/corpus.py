"""Corpus reports and selections: profiles, summaries, samples, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

#: Marks of an answer that changed a mind.
DELTA = r"(?i)[Δ∆]|delta"
QUESTION = r"(?s)Question:\n(.*?)\n\nNow provide"


def profile(df: DataFrame, **distinct: str) -> DataFrame:
    """One row: the number of rows, and of distinct values of each named column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(F.col(c)).alias(name) for name, c in distinct.items()])


def dataset_summary(df: DataFrame, by: list[str], prompt: str, response: str) -> DataFrame:
    """Records and mean words of prompts and of responses, to one decimal."""
    words = [F.round(F.coalesce(F.avg(T.n_words(F.col(c))), F.lit(0.0)), 1).alias(f"avg_{name}_words") for c, name in ((prompt, "prompt"), (response, "response"))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_records"), *words)


def pair_summary(candidates: DataFrame, chosen: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Pairs, groups skipped, and mean quality and rarity of the chosen, rounded to 4
    decimals before the mean. `by` is a part of `group`; chosen has quality and rarity."""
    c = chosen.select(*group, F.round("quality", 4).alias("_q"), F.round("rarity", 4).alias("_r"), F.lit(1).alias("_1"))
    g = candidates.select(*group).distinct().join(c, group, "left").groupBy(*by)
    return g.agg(
        F.count("_1").alias("total_pairs"),
        F.sum(F.when(F.col("_1").isNull(), 1).otherwise(0)).alias("total_skipped"),
        F.coalesce(F.avg("_q"), F.lit(0.0)).alias("avg_chosen_quality"),
        F.coalesce(F.avg("_r"), F.lit(0.0)).alias("avg_chosen_rarity"),
    )


def question_of(t: Column) -> Column:
    """The text between the markers, or the whole text; trimmed."""
    found = F.regexp_extract(t, QUESTION, 1)
    return F.regexp_replace(F.when(t.rlike(QUESTION), found).otherwise(t), r"(?U)^\s+|\s+$", "")


def delta_references(df: DataFrame, text: str, score: str, meta: str | None = None, low: int = 20, high: int = 300, enough: int = 100) -> DataFrame:
    """Rows whose text has a mark, whose score is above 0, or of which a value of the map `meta`
    has the word of the mark, of low to high words; with
    fewer than `enough` of them, rows scoring over 5 follow, as further rows. Null: no mark."""
    fit = df.where(T.n_words(F.col(text)).between(low, high))
    marked = F.coalesce(F.col(text).rlike(DELTA), F.lit(False)) | F.coalesce(F.col(score) > 0, F.lit(False))
    if meta:
        marked |= F.coalesce(F.exists(F.map_values(meta), lambda v: F.lower(v).contains("delta")), F.lit(False))
    first = fit.where(marked)
    few = first.agg((F.count(F.lit(1)) < enough).alias("_few")).where("_few")  # a row, or none
    more = fit.where(F.col(score) > 5).join(F.broadcast(few), how="cross").drop("_few")
    return first.unionByName(more)


def first_prompts(df: DataFrame, prompt: str, n: int) -> DataFrame:
    """Rows of the n first prompts, in the order of the prompt."""
    return df.join(df.select(prompt).distinct().orderBy(prompt).limit(n), prompt, "left_semi")


def missing(required: DataFrame, available: DataFrame, on: list[str]) -> DataFrame:
    """Required rows that aren't available."""
    return required.join(available.select(*on), on, "left_anti")


def calibration_sample(df: DataFrame, key: str, fraction: float = 0.1, least: int = 10, seed: int = 0, bits: int = 12) -> DataFrame:
    """Without replacement max(least, floor(n * fraction)) rows, those of the least hashes.

    Whole hash ranges are taken while they fit; only the range at the border is ranked,
    so no task sees more than one of 2^bits ranges.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(1 << (32 - bits))
    rows = df.withColumn("_h", h).withColumn("_b", F.floor(bucket))
    per = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 2^bits rows
    before = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    k = F.greatest(F.lit(least), F.floor(F.sum("_c").over(Window.partitionBy()) * fraction))
    edges = per.select("_b", "_c", before.alias("_before"), k.alias("_k")).where("_before < _k")
    near = rows.join(F.broadcast(edges), "_b")
    inside = near.where("_before + _c <= _k")
    border = near.where("_before + _c > _k").withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return inside.select(*df.columns).unionByName(border.where("_before + _rn <= _k").select(*df.columns))


def first_appearance(df: DataFrame, value: str, order: str) -> DataFrame:
    """Values with the rank of the first row that has them."""
    g = df.groupBy(value).agg(F.min(order).alias("first"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy("first")))


def merge_metrics(automated: DataFrame, judged: DataFrame) -> DataFrame:
    """method, metric, mean of both; where both have a metric the judge's counts."""
    a = automated.select("method", "metric", F.col("mean").alias("_a"))
    j = judged.select("method", "metric", F.col("mean").alias("_j"))
    return a.join(j, ["method", "metric"], "full").select("method", "metric", F.coalesce("_j", "_a").alias("mean"))
