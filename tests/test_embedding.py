"""The embedder hook: openings, batches, and what fails."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import embedding
from loomline.plans import extended


def noted(folder, dim=3, result=None):
    """An embedder that notes each opening and each call in a file of its worker."""

    def open_model():
        open(f"{folder}/open-{os.getpid()}-{time.time_ns()}", "w").close()

        def model(texts):
            with open(f"{folder}/asked-{os.getpid()}", "a") as f:
                f.write(f"{len(texts)} {sum(len(t.encode()) for t in texts)}\n")
            return result(texts) if result else np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return model

    return open_model


def asked(folder):
    return [tuple(map(int, x.split())) for f in os.listdir(folder) if f.startswith("asked") for x in open(folder / f)]


def test_model_is_opened_once_a_worker(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(40)
    got = embedding.embed(df, noted(tmp_path), 3)
    assert got.where(F.col("embedding")[0] != F.length("text")).count() == 0
    opened = [f for f in os.listdir(tmp_path) if f.startswith("open")]
    workers = {f.split("-")[1] for f in opened}
    assert len(opened) == len(workers) <= 8 < 40  # one a worker, fewer than tasks
    assert sum(n for n, _ in asked(tmp_path)) == 20_000


def test_batches_are_bounded_and_whole(spark, tmp_path):
    rows = [(k, "a" * (k * 37 % 400)) for k in range(300)] + [(300, "é" * 5_000)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"][0] for r in embedding.embed(df, noted(tmp_path), 3, max_rows=9, max_bytes=1_000).collect()}
    assert got == {k: len(t) for k, t in rows}
    calls = asked(tmp_path)
    assert all(n <= 9 and (b <= 1_000 or n == 1) for n, b in calls) and (1, 10_000) in calls
    assert sum(n for n, _ in calls) == len({t for _, t in rows})  # a text is asked once a batch


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (3, "banana", None)], "id long, Text string, embedding double")
    out = embedding.embed(df, noted(tmp_path), 3)
    assert out.columns == ["id", "Text", "embedding"]
    assert [(r["id"], r["embedding"]) for r in out.orderBy("id").collect()] == [(1, None), (2, [0, 0, 1]), (2, [0, 0, 1]), (3, [6, 3, 1])]
    assert embedding.embed(df.limit(0), noted(tmp_path / "none"), 3).count() == 0
    with pytest.raises(ValueError, match="no column"):
        embedding.embed(df, noted(tmp_path), 3, text="body")
    with pytest.raises(ValueError, match="dim"):
        embedding.embed(df, noted(tmp_path), 0)


@pytest.mark.parametrize(("result", "why"), [(lambda t: np.ones((len(t), 2)), "dimension 3"), (lambda t: np.ones((len(t) + 1, 3)), "the embedder gave"), (lambda t: [[np.nan] * 3] * len(t), "finite")])
def test_wrong_results_fail(spark, tmp_path, result, why):
    df = spark.range(5).select(F.lit("x").alias("text"))
    with pytest.raises(Exception, match=why):
        embedding.embed(df, noted(tmp_path, result=result), 3).collect()


def test_hash_embedder_is_fixed():
    model = embedding.hash_embedder(2)()
    assert model(["a"]) == model(["b", "a"])[1:]
    assert extended._DIM == 8
