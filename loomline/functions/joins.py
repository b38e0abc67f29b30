"""Joins on keys of which null is a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left's columns, then right's that aren't keys; null keys match null keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], how).drop(*[f"_r_{c}" for c in keys])
