import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import corpus, records, lexical, pairs, reports, routing


def brute_rarity(texts):
    out = []
    for k, t in enumerate(texts):
        own, others = set((t or "").lower().split()), set(" ".join(x or "" for x in texts[:k] + texts[k + 1 :]).lower().split())
        tok = re.findall(r"\w+", (t or "").lower())
        shared = len(own & others) / len(own) if own and len(texts) > 1 else 0
        out.append(max(0, (len(set(tok)) / len(tok) if tok else 0) - shared))
    top = max(out)
    return [x / top if top else 0 for x in out]


@pytest.mark.parametrize("texts", [["a b c", "a b d", "e f a"], ["same words", "same words"], ["alone here alone"], [None, "", "x y"]])
def test_lexical_rarity(spark, texts):
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "g string, id int, t string")
    got = {r["id"]: r["rarity"] for r in lexical.lexical_rarity(df, ["g"], "t", "id").collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_rarity(texts))


def test_overlap(spark):
    df = spark.createDataFrame([("g", 1, "a a b"), ("g", 2, "a c"), ("h", 3, "z")], "g string, id int, t string")
    got = {r["g"]: r["overlap"] for r in lexical.overlap_self_bleu(df, ["g"], "t", "id").collect()}
    assert got == pytest.approx({"g": (2 / 3 + 1 / 2) / 2, "h": 0.0})
    assert lexical.overlap_self_bleu(df.limit(0), ["g"], "t", "id").count() == 0


def test_hysteresis(spark):
    turns = [("c", 1, 0.5, 0.4), ("c", 2, 0.5, 0.54), ("c", 3, 0.5, 0.56), ("c", 4, None, None), ("d", 1, 0.2, 0.2)]
    df = spark.createDataFrame(turns, "conv string, turn int, a double, b double")
    got = {(r["conv"], r["turn"]): r["persona"] for r in routing.hysteresis(df, "conv", "turn", {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {("c", 1): "a", ("c", 2): "a", ("c", 3): "b", ("c", 4): "b", ("d", 1): "a"}


def test_gates(spark):
    df = spark.createDataFrame([("simple minimal x",), (None,)], "t string")
    ranked = df.select(routing.top(routing.keyword_scores(F.col("t"), {"m": ["simple", "minimal"], "c": ["x"], "b": ["x"]}), 2).alias("r")).collect()
    assert [[(x["persona"], x["score"]) for x in r["r"]] for r in ranked] == [[("m", 2), ("b", 1)], [("b", 0), ("c", 0)]]
    with pytest.raises(ValueError, match="unknown"):
        routing.forced(["x"], ["a"])


def test_older_pair_rule(spark):
    rows = [("p", 1, "a", 0.85, 0.10), ("p", 2, "b", 0.80, 0.15), ("p", 3, "c", 0.70, 0.85), ("p", 4, "d", 0.10, 0.95), ("q", 5, "e", 0.9, 0.9), ("r", 6, "f", 0.1, 0.1), ("r", 7, "g", 0.2, 0.1)]
    df = spark.createDataFrame(rows, "p string, id int, text string, quality double, rarity double")
    got = [(r["p"], r["chosen"]["id"], r["rejected"]["id"]) for r in pairs.select_pairs_any(df, ["p"], "id", 0.35, 0.4, 0.6).collect()]
    assert got == [("p", 3, 4)]  # under the floor goes before the worst over it; one candidate, or none over the floor: no pair


@pytest.mark.parametrize(("n", "want"), [(0, 0), (7, 7), (50, 10), (999, 99), (1000, 100)])
def test_calibration_sample(spark, n, want):
    got = [r["id"] for r in corpus.calibration_sample(spark.range(n), "id", bits=4).collect()]
    assert len(got) == len(set(got)) == want


def test_delta_references(spark):
    long = "word " * 20
    rows = [(1, long + "Delta", 0), (2, long, 1), (3, long, None), (4, "delta", 0), (5, long, 9), (6, None, 9)]
    df = spark.createDataFrame(rows, "id int, t string, score int")
    assert sorted(r["id"] for r in corpus.delta_references(df, "t", "score").collect()) == [1, 2, 5, 5]
    assert sorted(r["id"] for r in corpus.delta_references(df, "t", "score", enough=3).collect()) == [1, 2, 5]


def test_question_and_text(spark):
    df = spark.createDataFrame([("x\nQuestion:\n why \n me\n\nNow provide it",), (" whole ",), (None,)], "t string")
    assert [r[0] for r in df.select(corpus.question_of(F.col("t"))).collect()] == ["why \n me", "whole", None]
    assert [r[0] for r in df.select(F.length(records.as_text(F.col("t")))).collect()][2] == 0


def test_reports(spark, tmp_path):
    tests = spark.createDataFrame([("self_bleu", "base", 0.5, 0.001), ("quality", "base", -0.1, 0.02), ("quality", "other", 0.1, 0.6)], "metric string, method string, mean_diff double, p_value double")
    md = reports.significance_markdown(tests, "ours")
    assert "| ours vs base | +0.500** (p=0.001) | -0.100* (p=0.020) |" in md and "| ours vs other | — | +0.100 (p=0.600) |" in md
    assert "better on 1 (Self-BLEU); worse on 1 (Quality(L))" in md
    path = str(tmp_path / "examples.md")
    rows = spark.range(5).select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    for _ in range(2):
        reports.append_examples(rows, "id", "Examples", path)
    text = open(path, encoding="utf-8").read()
    assert text.count("# Examples") == 2 and text.count("**user:**") == 6


def test_merge_and_missing(spark):
    a = spark.createDataFrame([("m", "q", 1.0), ("m", "l", 2.0)], "method string, metric string, mean double")
    j = spark.createDataFrame([("m", "q", 5.0), ("n", "q", 3.0)], "method string, metric string, mean double")
    assert {(r[0], r[1]): r[2] for r in corpus.merge_metrics(a, j).collect()} == {("m", "q"): 5.0, ("m", "l"): 2.0, ("n", "q"): 3.0}
    assert [tuple(r) for r in corpus.missing(j.select("method"), a, ["method"]).collect()] == [("n",)]
    assert [r["rank"] for r in corpus.first_appearance(spark.createDataFrame([(3, "x"), (1, "y")], "i int, v string"), "v", "i").orderBy("first").collect()] == [1, 2]
