"""Bounds of the classifier's sample, and its thresholds."""

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import toxicity


def test_a_long_text_leaves_both_labels_in(spark):
    """Whatever its place in the sample, a text over max_chars ends nothing."""
    rows = [(k, ("bad awful " if k % 2 else "good nice ") * 5, k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    for long in range(0, 60, 7):
        own = docs.withColumn("text", F.when(F.col("doc_id") == long, F.repeat(F.lit("word "), 2_000)).otherwise(F.col("text")))
        model = toxicity.train(own, docs.select("doc_id", F.col("y").alias("toxic")), max_chars=1_500, fold=None)
        assert model.constant is None


def test_thresholds_lie_between_the_labels():
    model, rng = toxicity.Model(), np.random.default_rng(1)
    logits = np.concatenate([rng.normal(-8, 1, 300), rng.normal(9, 2, 30)])
    y, langs = np.repeat([0.0, 1.0], [300, 30]), rng.integers(0, 3, 330)
    model._calibrate(logits, langs, y, np.ones(330))
    assert ((model.shift[:3] > -5) & (model.shift[:3] < 4)).all() and model.shift[4] == model.shift[3]
    same = toxicity.Model()
    same._calibrate(logits, langs, np.zeros(330), np.ones(330))
    assert (same.shift == 0).all()
