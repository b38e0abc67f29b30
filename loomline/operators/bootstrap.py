"""Paired bootstrap of groups of any size: multinomial draws by recursive binomial splitting.

A group's equal differences are counted together, and the distinct ones dealt by hash into cells
of bounded size, the leaves of a binary tree. At each node the draws of every resample are split
between its two sides by a binomial number that depends on the seed, the node and the sides'
sizes alone. So a cell that knows the sizes along its path knows its own draws of each resample,
and the resamples' sums are partial aggregates over cells: nothing holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.joins import null_join
from loomline.sources.scratch import written


def split(draws: np.ndarray, left: int, right: int, seed: int, level: int, node: int) -> np.ndarray:
    """How many of a node's draws, by resample, go to its left side."""
    return np.random.default_rng([seed, level, node]).binomial(draws, left / (left + right))


def cell_draws(n: int, resamples: int, path: list[tuple[int, int, int]], cell: int, seed: int) -> np.ndarray:
    """Draws of a cell by resample. path: (level, left size, right size) of its nodes, from the
    root (the highest level) down to level 1; a node is the cell's number without `level` bits."""
    draws = np.full(resamples, n, np.int64)
    for level, left, right in sorted(path, reverse=True):
        to_left = split(draws, left, right, seed, level, cell >> level)
        draws = draws - to_left if cell >> (level - 1) & 1 else to_left
    return draws


def cell_sums(values: np.ndarray, weights: np.ndarray, draws: np.ndarray, seed: int, cell: int) -> np.ndarray:
    """Sum of a cell's drawn values by resample. values are distinct; weights are their counts."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    upto, rng = np.cumsum(weights), np.random.default_rng([seed, 0, cell])
    if len(values) == 1:
        return draws * values[0]
    out = np.empty(len(draws))
    for r, m in enumerate(draws):
        if m <= 8 * len(values):
            out[r] = values[np.searchsorted(upto, rng.integers(0, upto[-1], m), "right")].sum()
        else:  # more draws than it pays to make one by one
            out[r] = rng.multinomial(m, weights / upto[-1]) @ values
    return out


def bootstrap_split(diffs: DataFrame, resamples: int = 1000, by: tuple[str, ...] = ("metric", "method"), value: str = "diff", seed: int = 0, leaf: int = 4096) -> DataFrame:
    """by, mean_diff, p_value (share of resampled means that aren't above 0), p_loss (not below
    0), effect_size (mean over standard deviation; 0 without any), n.

    Rows are the pairs; null differences don't count, and a group without others gives no row. A
    null in `by` is a group. The result depends on a group's differences, not on their order or
    partitions, and the draws on the seed, not on the group. leaf: distinct differences a cell, on
    average; a cell is what a task holds. Means are rounded to 9 places before they meet 0.
    """
    by = list(by)
    own = diffs.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_d"))
    weights = own.groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("_w"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_w") * F.pow(F.col("_d") - F.col("_mean"), 2)) / F.greatest(F.first("_n") - 1, F.lit(1))))
    weights = written(weights, "bootstrap-weights")
    size = weights.groupBy(*by).agg(F.sum("_w").alias("_n"), (F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("_mean"), F.count(F.lit(1)).alias("_k"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("_k") / leaf)).cast("long")
    levels = F.when(cells > 1, F.length(F.bin(cells - 1))).otherwise(0)
    size = size.select(*by, "_n", "_mean", cells.alias("_cells"), levels.alias("_levels"))
    dealt = null_join(weights, size, by).withColumn("_cell", F.pmod(F.xxhash64("_d"), F.col("_cells")))

    # Sizes of the tree's nodes, then of both sides of every node on a cell's path.
    leaves = dealt.groupBy(*by, "_cell").agg(F.sum("_w").alias("_w"), F.first("_levels").alias("_levels"), F.first("_n").alias("_n"))
    nodes = leaves.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_levels")))).groupBy(*by, "_level", F.call_function("shiftright", F.col("_cell"), F.col("_level")).alias("_node")).agg(F.sum("_w").alias("_size"))
    steps = leaves.where("_levels > 0").withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_levels"))))
    parent = F.call_function("shiftright", F.col("_cell"), F.col("_level"))
    sides = steps.select(*by, "_cell", "_n", F.col("_level").alias("_at"), (F.col("_level") - 1).alias("_level"), F.explode(F.array(2 * parent, 2 * parent + 1)).alias("_node"))
    path = null_join(sides, nodes, [*by, "_level", "_node"], "left").groupBy(*by, "_cell", "_at").agg(
        F.sum(F.when(F.col("_node") % 2 == 0, F.col("_size"))).alias("_left"), F.sum(F.when(F.col("_node") % 2 == 1, F.col("_size"))).alias("_right")
    )
    roots = leaves.select(*by, "_cell", F.lit(0).alias("_at"), F.col("_n").alias("_left"), F.lit(None).cast("long").alias("_right"))
    path = roots.unionByName(path)
    path = path.select(*[F.col(c).alias(f"_p_{k}") for k, c in enumerate([*by, "_cell"])], "_at", "_left", "_right")

    def sums(rows: pa.Table, own_path: pa.Table) -> pa.Table:
        cell = rows["_cell"][0].as_py()
        steps = [(a, left or 0, right or 0) for a, left, right in zip(own_path["_at"].to_pylist(), own_path["_left"].to_pylist(), own_path["_right"].to_pylist(), strict=True)]
        n = next(left for a, left, _ in steps if a == 0)
        draws = cell_draws(n, resamples, [s for s in steps if s[0] > 0], cell, seed)
        got = cell_sums(rows["_d"].to_numpy(), rows["_w"].to_numpy(), draws, seed, cell)
        return pa.table({**{c: rows[c].slice(0, 1) for c in by}, "_sums": pa.array([got.tolist()], pa.list_(pa.float64()))})

    kinds = ", ".join(f"`{c}` {weights.schema[c].dataType.simpleString()}" for c in by)
    each = dealt.select(*by, "_cell", "_d", "_w").groupBy(*by, "_cell").cogroup(path.groupBy(*path.columns[:-3])).applyInArrow(sums, f"{kinds}, _sums array<double>")
    total = each.select(*by, F.posexplode("_sums").alias("_r", "_s")).groupBy(*by, "_r").agg(F.sum("_s").alias("_s"))
    mean = F.round(F.col("_s") / F.col("_n"), 9)
    wins = null_join(total, size, by).groupBy(*by).agg(F.count(F.when(mean > 0, 1)).alias("_win"), F.count(F.when(mean < 0, 1)).alias("_loss"))
    base = dealt.groupBy(*by).agg(F.first("_mean").alias("mean_diff"), std.alias("_std"), F.first("_n").alias("n"))
    effect = F.when(F.col("_std") <= 1e-9, F.lit(0.0)).otherwise(F.col("mean_diff") / F.col("_std"))
    return null_join(base, wins, by).select(
        *by, "mean_diff", (1 - F.col("_win") / resamples).alias("p_value"), (1 - F.col("_loss") / resamples).alias("p_loss"), effect.alias("effect_size"), "n"
    )
