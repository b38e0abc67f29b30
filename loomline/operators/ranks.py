"""Average ranks of groups of any size: counts by value, and prefix sums in two levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.joins import null_join
from loomline.sources.scratch import written


def value_ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, v, rank and n (rows of the group) of each distinct value v. counts: by, v, c, a row a
    value; ties share the average rank.

    Values are sorted into ranges of (by, v), whose splitters Spark samples; each range adds up
    its own part of a group, and a group's ranges (not its rows) are added up by a window.
    """
    named = counts.select(F.struct(*by, F.lit(0).alias("_")).alias("g"), "v", "c")
    ranged = named.repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    inside = written(ranged.mapInArrow(_running, f"{kinds}, seg long, upto long"), "rank-ranges")
    own = Window.partitionBy("g")
    parts = inside.groupBy("g", "seg").agg(F.sum("c").alias("t")).select("g", "seg", (F.sum("t").over(own.orderBy("seg")) - F.col("t")).alias("before"), F.sum("t").over(own).alias("n"))
    rank = F.col("before") + F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    return inside.join(parts.drop("g"), "seg").select(*[F.col("g")[c].alias(c) for c in by], "v", rank.alias("rank"), "n")


def _running(batches):
    """Sorted g, v, c with the number of the range's part of the group, and counts up to the row."""
    seg, group, total = (TaskContext.get().partitionId() << 40) - 1, None, 0
    for batch in batches:
        codes = batch.column(0).to_pylist()
        counts = batch.column(2).to_numpy()
        segs, upto = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
        cuts = [i for i, g in enumerate(codes) if i == 0 or g != codes[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(counts)], strict=True):
            if codes[a] != group:
                seg, group, total = seg + 1, codes[a], 0
            sums = total + np.cumsum(counts[a:b])
            segs[a:b], upto[a:b], total = seg, sums, int(sums[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs), pa.array(upto)], names=[*batch.schema.names, "seg", "upto"])


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: Spearman's rank correlation of each group, null where a side is constant.

    Pairs with a null on either side don't count. Equal pairs are counted together first, so that
    a value that many rows share meets its rank once for each other value beside it.
    """
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y")).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w")), "rank-pairs")
    both = pairs
    for side in ("x", "y"):
        counts = pairs.groupBy(*by, F.col(side).alias("v")).agg(F.sum("w").alias("c"))
        # A group's ranks have the mean (n + 1) / 2, exactly.
        ranks = value_ranks(counts, by).select(*by, F.col("v").alias(side), (F.col("rank") - (F.col("n") + 1) / 2).alias(f"r{side}"))
        both = null_join(both, ranks, [*by, side])
    part = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    rho = part("rx", "ry") / F.nullif(F.sqrt(part("rx", "rx")) * F.sqrt(part("ry", "ry")), F.lit(0.0))
    return both.groupBy(*by).agg(F.sum("w").alias("n"), rho.alias("rho"))
