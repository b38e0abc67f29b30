"""The bootstrap by splitting against one process that makes the same splits."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import bootstrap, stats


def brute(diffs, cell_of, cells, resamples, seed):
    """Splits from the root down, over all cells at once."""
    count = Counter(diffs)
    held = {c: ([], []) for c in range(cells)}
    for v, w in count.items():
        held[cell_of[v]][0].append(v)
        held[cell_of[v]][1].append(w)
    levels = (cells - 1).bit_length() if cells > 1 else 0
    size = lambda level, node: sum(sum(held[c][1]) for c in range(node << level, min(cells, (node + 1) << level)))
    total = np.zeros(resamples)

    def down(level, node, draws):
        if level == 0:
            if node < cells and held[node][0]:
                total[:] += bootstrap.cell_sums(np.array(held[node][0]), np.array(held[node][1]), draws, seed, node)
            return
        left, right = size(level - 1, 2 * node), size(level - 1, 2 * node + 1)
        if left + right:
            to_left = bootstrap.split(draws, left, right, seed, level, node)
            down(level - 1, 2 * node, to_left)
            down(level - 1, 2 * node + 1, draws - to_left)

    down(levels, 0, np.full(resamples, len(diffs)))
    means = np.round(total / len(diffs), 9)
    return 1 - (means > 0).mean(), 1 - (means < 0).mean()


@pytest.mark.parametrize(("n", "leaf"), [(1, 4), (7, 4), (3_000, 64), (3_000, 10_000), (500, 1)])
def test_equals_the_same_split_in_one_process(spark, n, leaf):
    r = np.random.default_rng(5)
    values = np.round(r.normal(0.02, 1, n), 2).tolist()
    df = spark.createDataFrame([("m", None, v) for v in values] + [("m", "x", 0.5)], "metric string, method string, diff double").repartition(5)
    cells = max(1, -(-len(set(values)) // leaf))
    cell_of = {x["v"]: x["c"] for x in spark.createDataFrame([(v,) for v in set(values)], "v double").select("v", F.pmod(F.xxhash64("v"), F.lit(cells)).alias("c")).collect()}
    got = {x["method"]: x for x in bootstrap.bootstrap_split(df, 200, leaf=leaf, seed=3).collect()}
    p, loss = brute(values, cell_of, cells, 200, 3)
    g = got[None]
    assert (g["p_value"], g["p_loss"]) == (pytest.approx(p), pytest.approx(loss))
    assert g["n"] == n and g["mean_diff"] == pytest.approx(np.mean(values))
    std = np.std(values, ddof=1) if n > 1 else 0
    assert g["effect_size"] == pytest.approx(np.mean(values) / std if std > 1e-9 else 0)
    assert (got["x"]["p_value"], got["x"]["p_loss"], got["x"]["effect_size"]) == (0, 1, 0)


def test_draws_are_multinomial():
    """Counts of a three-cell tree have the mean and variance of a multinomial."""
    sizes, n, resamples = [50, 30, 20], 100, 20_000
    path = {0: [(2, 80, 20), (1, 50, 30)], 1: [(2, 80, 20), (1, 50, 30)], 2: [(2, 80, 20), (1, 20, 0)]}
    drawn = np.stack([bootstrap.cell_draws(n, resamples, path[c], c, 1) for c in range(3)])
    assert (drawn.sum(0) == n).all()
    for c, s in enumerate(sizes):
        assert drawn[c].mean() == pytest.approx(s, abs=0.2) and drawn[c].var() == pytest.approx(n * s / 100 * (1 - s / 100), rel=0.05)
    assert np.cov(drawn[0], drawn[1])[0, 1] == pytest.approx(-n * 0.5 * 0.3, rel=0.06)


def test_agrees_with_draws_by_hash(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([("m", "x", k, float(v)) for k, v in enumerate(r.normal(0.1, 1, 300))], "metric string, method string, prompt int, diff double")
    a, b = bootstrap.bootstrap_split(df, 2_000, leaf=32).first(), stats.bootstrap(df, 2_000).first()
    assert a["p_value"] == pytest.approx(b["p_value"], abs=0.03) and a["effect_size"] == pytest.approx(b["effect_size"])


def test_edges(spark):
    schema = "metric string, method string, diff double"
    assert bootstrap.bootstrap_split(spark.createDataFrame([], schema), 10).count() == 0
    assert bootstrap.bootstrap_split(spark.createDataFrame([("m", "x", None)], schema), 10).count() == 0
    same = bootstrap.bootstrap_split(spark.createDataFrame([("m", "x", 0.0)] * 9, schema), 10).first()
    assert (same["mean_diff"], same["p_value"], same["p_loss"], same["effect_size"], same["n"]) == (0, 1, 1, 0, 9)


def test_ten_million_pairs_in_one_group(spark):
    """No task holds the group: the plan has no window and no list over it, cells are small."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("m").alias("metric"), F.lit("x").alias("method"), ((F.col("id") - n / 2 + 20_000) / n).alias("diff"))
    out = bootstrap.bootstrap_split(df, 8, leaf=4096)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    r = out.first()
    assert r["n"] == n and r["mean_diff"] == pytest.approx(0.002, abs=1e-6)
    assert 0 <= r["p_value"] <= 0.1 and r["p_loss"] == 1  # the mean lies 22 standard errors above 0
