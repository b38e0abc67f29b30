"""Cosine family in closed form: group sums of unit vectors instead of pair joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its norm; a vector of almost no length becomes zeros."""
    d = F.transform(v, lambda x: x.cast("double"))
    # A list of one binds the norm: inside transform(d, ...) it would be taken anew for each value.
    held = F.array(F.struct(d.alias("d"), F.sqrt(dot(d, d)).alias("n")))
    return F.transform(held, lambda h: F.transform(h["d"], lambda x: F.when(h["n"] < 1e-9, F.lit(0.0)).otherwise(x / h["n"])))[0]


def dimension(df: DataFrame, col: str) -> int:
    row = df.where(F.col(col).isNotNull()).select(F.size(col)).first()
    return row[0] if row else 0


def vector_sum(col: str, dim: int) -> Column:
    """One pass, partial aggregates: a sum for each place of the vector."""
    return F.array(*[F.sum(F.col(col)[i]) for i in range(dim)]) if dim else F.array().cast("array<double>")


def with_unit(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("u", unit(F.col(col)))


def group_sums(df: DataFrame, by: list[str], dim: int) -> DataFrame:
    """n, S (sum of unit vectors), q (sum of squared lengths) of each group; df has u."""
    return df.withColumn("_q", dot(F.col("u"), F.col("u"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), vector_sum("u", dim).alias("S"), F.sum("_q").alias("q")
    )


def mean_pairwise(n: Column, s: Column, q: Column) -> Column:
    """Mean cosine over unordered pairs; 0 for fewer than two."""
    return F.when(n < 2, F.lit(0.0)).otherwise((dot(s, s) - q) / (n * (n - 1)))


def others_mean(u: Column, n: Column, s: Column) -> Column:
    """Mean cosine of a member with the others of its group; null if it has none."""
    return F.when(n > 1, (dot(u, s) - dot(u, u)) / (n - 1))


def centroid_distance(s: Column, t: Column) -> Column:
    """Cosine distance of two sums; 0 where one has almost no length."""
    size = F.sqrt(dot(s, s)) * F.sqrt(dot(t, t))
    return F.when(size <= 1e-9, F.lit(0.0)).otherwise(1 - dot(s, t) / size)
