"""Exact nearest references against all pairs."""

import numpy as np
import pytest

from loomline.operators import neighbours

LEFT, RIGHT = "id long, u array<double>", "ref_id long, ru array<double>"


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-9, 0, x / np.where(n < 1e-9, 1, n))


def brute(left, right, k):
    out = []
    for i, u in left:
        sims = sorted((-round(float(np.dot(u, v)), 9), j) for j, v in right)
        out += [(i, r, j, -d) for r, (d, j) in enumerate(sims[:k], 1)]
    return sorted(out)


def run(spark, left, right, k, **options):
    frames = [spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], schema).repartition(4) for rows, schema in ((left, LEFT), (right, RIGHT))]
    got, work = neighbours.search(*frames, k, **options)
    return sorted((r["id"], r["rank"], r["ref_id"], r["similarity"]) for r in got.collect()), work.first()


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


def clustered(r, n, dim, centres):
    return unit(centres[r.integers(0, len(centres), n)] + 0.08 * r.normal(size=(n, dim)))


@pytest.mark.parametrize(("k", "block_rows", "pivots"), [(1, 50, 16), (3, 20, 8), (7, 5, 40), (3, 5_000, 1)])
def test_equals_all_pairs(spark, k, block_rows, pivots):
    r = np.random.default_rng(k)
    centres = unit(r.normal(size=(12, 10)))
    left = list(enumerate(clustered(r, 300, 10, centres)))
    right = [(10_000 + j, v) for j, v in enumerate(clustered(r, 900, 10, centres))]
    got, work = run(spark, left, right, k, block_rows=block_rows, pivots=pivots, queries_a_task=40)
    same(got, brute(left, right, k))
    assert work["of"] == 300 * 900
    if pivots > 1:
        assert work["pairs"] < 0.6 * work["of"]  # blocks are skipped


def test_unclustered_vectors_and_ties(spark):
    r = np.random.default_rng(9)
    common = unit(r.normal(size=(1, 6)))[0]
    right = [(j, common if j % 3 else v) for j, v in enumerate(unit(r.normal(size=(600, 6))))]  # one vector holds most rows
    left = [*enumerate(unit(r.normal(size=(40, 6)))), (40, common), (41, np.zeros(6))]
    got, work = run(spark, left, right, 4, block_rows=30, pivots=8, queries_a_task=7)
    same(got, brute(left, right, 4))
    assert work["pairs"] < 0.6 * work["of"]  # copies of a vector beyond k aren't met


def test_edges(spark):
    one = [(1, [1.0, 0.0])]
    assert run(spark, one, [], 2) == ([], (0, 0))
    got, _ = run(spark, one, [(5, [0.5, 0.5]), (4, [0.5, 0.5])], 3)
    assert got == [(1, 1, 4, 0.5), (1, 2, 5, 0.5)]
    assert run(spark, [], [(5, [0.5, 0.5])], 3)[0] == []
    frames = spark.createDataFrame([(1, None), (2, [1.0])], LEFT), spark.createDataFrame([("b", None), ("a", [2.0])], "ref_id string, ru array<double>")
    assert [tuple(r) for r in neighbours.search(*frames, 1)[0].collect()] == [(2, 1, "a", 2.0)]


def test_groups_meet_only_themselves(spark):
    r = np.random.default_rng(1)
    left = [(i, "ab"[i % 2] if i % 5 else None, v.tolist()) for i, v in enumerate(unit(r.normal(size=(60, 5))))] + [(99, "c", [1.0] * 5)]
    right = [(j, "ab"[j % 2], v.tolist()) for j, v in enumerate(unit(r.normal(size=(90, 5))))]
    got, work = neighbours.search(spark.createDataFrame(left, "id int, g string, u array<double>"), spark.createDataFrame(right, "ref_id int, g string, ru array<double>"), 3, by=True, block_rows=6, pivots=5)
    want = [x for g in "ab" for x in brute([(i, u) for i, h, u in left if h == g], [(j, v) for j, h, v in right if h == g], 3)]
    same(sorted((x["id"], x["rank"], x["ref_id"], x["similarity"]) for x in got.collect()), sorted(want))
    assert work.first()["of"] == 48 * 45


def test_silhouette_of_many_labels(spark):
    """Thousands of labels: equal to all pairs of points on a sample, and no point meets all labels."""
    from loomline.functions import vectors as V
    from loomline.operators import reports

    r = np.random.default_rng(7)
    centres = unit(r.normal(size=(40, 8)))
    means = unit(centres[r.integers(0, 40, 3_000)] + 0.1 * r.normal(size=(3_000, 8)))
    label = r.integers(0, 3_000, 9_000)
    points = unit(means[label] + 0.05 * r.normal(size=(9_000, 8)))
    df = spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(label, points, strict=True))], "vec_id int, label int, embedding array<double>")
    got = {x["vec_id"]: x["silhouette"] for x in reports.silhouette(V.with_unit(df), "label", 8).collect()}
    sums, n = np.zeros((3_000, 8)), np.bincount(label, minlength=3_000)
    np.add.at(sums, label, points)
    for k in range(0, 9_000, 37):
        c = label[k]
        if n[c] < 2:
            assert k not in got
            continue
        dist = 1 - points[k] @ (sums / np.maximum(n, 1)[:, None]).T
        a, b = 1 - (points[k] @ sums[c] - 1) / (n[c] - 1), min(d for j, d in enumerate(dist) if j != c and n[j])
        assert got[k] == pytest.approx((b - a) / max(a, b), abs=1e-6)
