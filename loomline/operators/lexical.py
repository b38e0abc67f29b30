"""Diversity from shared words: rarity in a group of answers, and overlap with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T


def word_overlap(df: DataFrame, by: list[str], text: str, key: str) -> DataFrame:
    """For each row: n_members of its group, and the shares of its distinct words and of all
    its words that some other member has too (null without words).

    A word is shared unless one member alone has it, so counts by (group, word) are enough:
    no pair of members meets, and a frequent word is one row after partial aggregation.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\S+"), F.lit(0))
    rows = df.select(*by, F.col(key).alias("_k"), words.alias("_w"))
    each = rows.select(*by, "_k", F.explode("_w").alias("w")).groupBy(*by, "_k", "w").agg(F.count(F.lit(1)).alias("tf"))
    alone = each.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("m"), F.min("_k").alias("_k"), F.sum("tf").alias("tf")).where("m = 1")
    own = alone.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("a"), F.sum("tf").alias("b"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_members"))
    n, d = F.size("_w"), F.size(F.array_distinct("_w"))
    joined = rows.select(*by, "_k", n.alias("n"), d.alias("d")).join(own, [*by, "_k"], "left").join(sizes, by)

    def share(part, whole):
        return F.when(F.col("n_members") < 2, F.when(F.col(whole) > 0, 0.0)).otherwise(1 - F.coalesce(F.col(part), F.lit(0)) / F.nullif(F.col(whole), F.lit(0)))

    return joined.select(*by, F.col("_k").alias(key), "n_members", share("a", "d").alias("distinct_share"), share("b", "n").alias("word_share"))


def lexical_rarity(df: DataFrame, by: list[str], text: str, key: str) -> DataFrame:
    """Distinct-1 of a row less its share of words that others have, at least 0, over the
    greatest of the group (0 where that is 0)."""
    tok = T.tokens(F.coalesce(F.col(text), F.lit("")))
    own = df.select(*by, key, F.coalesce(F.size(F.array_distinct(tok)) / F.nullif(F.size(tok), F.lit(0)), F.lit(0.0)).alias("_d1"))
    shared = word_overlap(df, by, text, key).select(*by, key, "distinct_share")
    raw = own.join(shared, [*by, key]).withColumn("_raw", F.greatest(F.lit(0.0), F.col("_d1") - F.coalesce("distinct_share", F.lit(0.0))))
    top = raw.groupBy(*by).agg(F.max("_raw").alias("_top"))
    return raw.join(top, by).select(*by, key, F.when(F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(0.0).alias("rarity"))


def overlap_self_bleu(df: DataFrame, by: list[str], text: str, key: str) -> DataFrame:
    """Mean over a group of the share of a row's words that others have; alone: 0."""
    return word_overlap(df, by, text, key).groupBy(*by).agg(F.avg(F.coalesce("word_share", F.lit(0.0))).alias("overlap"))
