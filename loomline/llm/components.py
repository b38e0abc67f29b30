"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, label) for each node of edges (a, b): the label is its component's least node.

    Edges may repeat, run either way, and join a node with itself. Each round writes its
    edges to the shared folder. Large-star joins a node's larger neighbours to its least
    neighbour, small-star its smaller ones; rounds are logarithmic in a component's size.
    The least neighbour is a partial aggregate; it is written, and joining it back leaves a
    hot node's rows on the side that adaptive execution can split.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    seen = None
    while True:
        own = _checksum(now)
        if own == seen:
            break
        seen = own
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialise(least, what)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), what)
        discard(now)
        discard(least)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), what)  # edges lead to smaller nodes
        joined = large.join(least, "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a <> b").distinct(), what)
        discard(large)
        discard(least)
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select(F.col("b"), F.col("b")))
