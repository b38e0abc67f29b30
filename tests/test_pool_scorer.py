"""The pool scorer: calls, order, bounds, and what fails."""

import os

import pytest
from pyspark.sql import functions as F

from loomline.operators import pairs


def noted(folder, score=lambda t: float(len(t))):
    def call(prompt, texts):
        with open(f"{folder}/{os.getpid()}-{os.urandom(6).hex()}", "w") as f:
            f.write("\n".join([prompt or "", *texts]))
        return [score(t) for t in texts]

    return call


def calls(folder):
    return [open(folder / f).read().split("\n") for f in os.listdir(folder)]


def test_small_pools_are_asked_once_in_order(spark, tmp_path):
    rows = [(p, k, f"{p}", f"{p} {k:02d}") for p in ("a", "b", None, *[f"p{n}" for n in range(50)]) for k in range(7)]
    df = spark.createDataFrame(rows, "pool string, doc_id int, prompt string, text string").orderBy(F.rand(1)).repartition(9)
    got = pairs.with_quality(df, ["pool"], noted(tmp_path), batch_rows=7)
    assert got.columns == [*df.columns, "quality"] and got.where(F.col("quality") != F.length("text")).count() == 0
    asked = {c[0]: c[1:] for c in calls(tmp_path)}
    assert len(asked) == 53  # each pool once (the count above is one run)
    assert all(texts == [f"{p or None} {k:02d}" for k in range(7)] for p, texts in asked.items())


def test_slices_have_bounds(spark, tmp_path):
    rows = [("a", k, "q", "x" * (k % 50)) for k in range(500)] + [("a", 500, "q", "y" * 900), ("b", 1, "q", None)]
    df = spark.createDataFrame(rows, "pool string, doc_id int, prompt string, text string")
    assert pairs.with_quality(df, ["pool"], noted(tmp_path), batch_rows=40, batch_bytes=600).count() == 502
    sizes = [(len(c) - 1, sum(map(len, c[1:]))) for c in calls(tmp_path)]
    assert all(n <= 40 and (b <= 600 or n == 1) for n, b in sizes) and (1, 900) in sizes and sum(n for n, _ in sizes) == 502


@pytest.mark.parametrize(("scorer", "why"), [(lambda p, t: [0.5] * (len(t) - 1), "5 scores for 6"), (lambda p, t: [0.5] * (len(t) + 1), "7 scores for 6"), (lambda p, t: [float("nan")] * len(t), "isn't a number")])
def test_wrong_answers_fail(spark, scorer, why):
    df = spark.range(6).select(F.lit("a").alias("pool"), F.col("id").alias("doc_id"), F.lit("p").alias("prompt"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match=why):
        pairs.with_quality(df, ["pool"], scorer).collect()


def test_empty_and_replaced(spark):
    df = spark.createDataFrame([("a", 1, "p", "t", 9.0)], "pool string, doc_id int, prompt string, text string, quality double")
    assert pairs.with_quality(df, ["pool"], lambda p, t: [0.25]).first()["quality"] == 0.25
    assert pairs.with_quality(df.limit(0), ["pool"], lambda p, t: 1 / 0).count() == 0


def test_a_pool_of_a_million(spark):
    """One pool, many tasks; each call has a slice of consecutive rows in order."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("pool"), F.col("id").alias("doc_id"), F.lit("p").alias("prompt"), F.format_string("%07d", "id").alias("text")).repartition(8)

    def scorer(prompt, texts):
        assert len(texts) <= 1024 and all(int(b) == int(a) + 1 for a, b in zip(texts, texts[1:]))
        return [int(t) % 1000 / 1000 for t in texts]

    got = pairs.with_quality(df, ["pool"], scorer).withColumn("task", F.spark_partition_id())
    r = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d"), F.max(F.abs(F.col("quality") - (F.col("doc_id") % 1000) / 1000)).alias("off"), F.countDistinct("task").alias("tasks")).first()
    assert (r["n"], r["d"]) == (n, n) and r["off"] < 1e-9 and r["tasks"] > 1
