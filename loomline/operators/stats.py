"""Summaries, paired bootstrap, rank correlation, verdicts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import ranks


def summarise(obs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, sample standard deviation (0 for one value), n; nulls are left out."""
    v = F.col(value)
    return obs.where(v.isNotNull()).groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count(v).alias("n"))


def with_empty(stats: DataFrame, dimension: DataFrame, by: list[str]) -> DataFrame:
    """A row for each of the dimension's values: (null, null, 0) where nothing was observed."""
    return dimension.select(*by).distinct().join(stats, by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def score_table(scores: DataFrame, methods: list[str], value: str = "score") -> DataFrame:
    """method, mean, std, n of each method, rounded to 4 (ties to even), in the methods' order; the
    standard deviation of one score is null."""
    s = scores.where(F.col(value).isNotNull()).groupBy("method").agg(F.bround(F.avg(value), 4).alias("mean"), F.bround(F.stddev_samp(value), 4).alias("std"), F.count(value).alias("n"))
    return s.where(F.col("method").isin(methods)).orderBy(F.array_position(F.array(*map(F.lit, methods)), F.col("method")))


def paired_differences(obs: DataFrame, reference: str, specs: DataFrame) -> DataFrame:
    """Differences by (metric, method, prompt), positive where the reference is better.

    obs: method, prompt, metric, value. specs: metric, lower_is_better. Pairs are joined
    on the prompt, not on the position in a list.
    """
    ref = obs.where(F.col("method") == reference).select("prompt", "metric", F.col("value").alias("a"))
    other = obs.where(F.col("method") != reference).select("prompt", "metric", "method", F.col("value").alias("b"))
    d = ref.join(other, ["prompt", "metric"]).join(F.broadcast(specs), "metric")
    return d.select("metric", "method", "prompt", F.when(F.col("lower_is_better"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b")).alias("diff"))


def draw_hash(resample: Column, draw: Column) -> Column:
    """A non-negative integer from md5, equal in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", resample.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("long")


def bootstrap(diffs: DataFrame, resamples: int = 1000, by: tuple[str, ...] = ("metric", "method"), order: str = "prompt", slice_: int = 50) -> DataFrame:
    """mean_diff, p_value (share of resampled means that aren't above 0), p_loss (not
    below 0), effect_size (mean over standard deviation), n.

    Draw k of resample r takes the pair of index md5(r:k) mod n, so results repeat.
    Resamples are spread over the cluster in slices. A group's pairs (one a prompt) stand in
    one row: 8 bytes each, so a group of ten million prompts takes 80 MB.
    """
    own = diffs.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    packed = own.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "diff"))), lambda x: x["diff"]).alias("d"))
    # Resamples go out in slices: a group's pairs are copied once a slice, not once a resample.
    each = packed.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(max(resamples - 1, 0)), F.lit(slice_))))
    n = F.size("d")

    def total(r):
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + F.element_at(F.col("d"), (draw_hash(r, k) % n + 1).cast("int")))

    drawn = F.transform(F.sequence(F.col("_from"), F.least(F.col("_from") + (slice_ - 1), F.lit(resamples - 1))), lambda r: F.round(total(r) / n, 9))
    count = lambda keep: F.sum(F.size(F.filter("_m", keep)))
    means = each.withColumn("_m", drawn).groupBy(*by).agg(
        (1 - count(lambda m: m > 0) / resamples).alias("p_value"), (1 - count(lambda m: m < 0) / resamples).alias("p_loss")
    )
    std = F.coalesce(F.stddev_samp("diff"), F.lit(0.0))
    base = own.groupBy(*by).agg(F.avg("diff").alias("mean_diff"), F.when(std <= 1e-9, F.lit(0.0)).otherwise(F.avg("diff") / std).alias("effect_size"), F.count(F.lit(1)).alias("n"))
    return base.join(means, list(by))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """rho, n and interpretation by group, of any size; fewer than three pairs are insufficient,
    and constant ranks have no rho. Pairs with a null on either side don't count."""
    g = ranks.rank_correlation(df, x, y, by)
    rho = F.when(F.col("n") >= 3, F.col("rho"))
    label = F.when(F.col("n") < 3, "insufficient").when(rho >= 0.8, "strong").when(rho >= 0.7, "good").when(rho >= 0.6, "moderate").otherwise("weak")
    return g.select(*by, "n", rho.alias("rho"), label.alias("interpretation"))


def spearman_by(df: DataFrame, rubrics: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Agreement of two judges by rubric: rubric, n, rho and p (rounded to 4), interpretation.

    rubrics: the columns of both judges' scores, by rubric. Pairs with a null on either side
    don't count. p is two-sided, from Student's t; null for fewer than three pairs.
    """
    by = by or []
    pair = F.explode(F.array(*[F.struct(F.lit(r).alias("rubric"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for r, (x, y) in rubrics.items()]))
    out = spearman(df.select(*by, pair.alias("_p")).select(*by, "_p.*"), "x", "y", [*by, "rubric"])

    @F.pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or r != r else spearman_p(r, int(m)) for r, m in zip(rho, n, strict=True)], dtype="float64")

    return out.select(*by, "rubric", "n", F.round("rho", 4).alias("rho"), F.round(p("rho", "n"), 4).alias("p"), "interpretation")


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p value from Student's t with n - 2 degrees, by the incomplete beta."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 200):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f
