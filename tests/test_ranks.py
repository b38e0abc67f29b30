"""Ranks by two-level prefix sums against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import ranks, stats


def windowed(df, x, y, by):
    """Average ranks by windows, as a check."""
    rank = lambda v: F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", rank(x)).withColumn("_y", rank(y))
    rho = F.covar_pop("_x", "_y") / F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0))
    return {tuple(v[c] for c in by): (v["n"], v["rho"]) for v in r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho")).collect()}


def check(df, by):
    got = {tuple(r[c] for c in by): (r["n"], r["rho"]) for r in ranks.rank_correlation(df, "x", "y", by).collect()}
    want = windowed(df, "x", "y", by)
    assert set(got) == set(want)
    for g, (n, rho) in want.items():
        assert got[g][0] == n and (got[g][1] == pytest.approx(rho, abs=1e-9) if rho is not None else got[g][1] is None), g


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_equals_windows(spark, by):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None, ""]), r.choice([1, None]), r.choice([None, 1.5, float("nan"), *range(40)]), r.choice([None, "p", "q", *map(str, range(9))])) for _ in range(2_000)]
    rows += [("one", 1, 3.0, "x"), ("same", 1, 3.0, "x"), ("same", 1, 3.0, "x"), ("null", 1, None, "x")]
    rows = [(g, h, float(x) if x is not None else None, y) for g, h, x, y in rows]
    check(spark.createDataFrame(rows, "g string, h int, x double, y string").repartition(5), by)


def test_labels_and_few_pairs(spark):
    df = spark.createDataFrame([("up", k, k * k) for k in range(5)] + [("two", 1, 1), ("two", 2, 2)], "g string, x int, y int")
    got = {r["g"]: (r["n"], r["rho"], r["interpretation"]) for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got == {"up": (5, pytest.approx(1.0), "strong"), "two": (2, None, "insufficient")}
    assert stats.spearman(df.limit(0), "x", "y", ["g"]).count() == 0


def test_four_large_groups(spark):
    """No window over a group's rows: ranges are as even as their sampled splitters, and windows
    see a row a range."""
    n = 2_400_000
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1_000_000.0
    df = spark.range(n).select((F.col("id") % 4).alias("g"), (noise(1) + F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(noise(1) + noise(2) * (F.col("id") % 4)).alias("y"))
    got = {r["g"]: r for r in ranks.rank_correlation(df, "x", "y", ["g"]).collect()}
    sample = df.where("g < 2")
    for g, (rows, rho) in windowed(sample, "x", "y", ["g"]).items():
        assert got[g[0]]["n"] == rows == n // 4 and got[g[0]]["rho"] == pytest.approx(rho, abs=1e-9)
    counts = df.groupBy("g", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    held = counts.repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()
    assert max(r[0] for r in held) <= 2 * sum(r[0] for r in held) / len(held)
