"""Details of metrics, reports and records: p values, JSON parts, white space, rounding."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import corpus, judge, metrics, persona_report, records, reports, stats


def student_p(rho, n):
    """Two-sided p by integrating Student's density with n - 2 degrees."""
    nu = n - 2
    t = abs(rho) * math.sqrt(nu / (1 - rho * rho))
    x = np.tan(np.linspace(math.atan(t), math.pi / 2 - 1e-9, 400_001))  # to infinity
    y = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(x * x / nu))
    return float(2 * np.sum((y[1:] + y[:-1]) / 2 * np.diff(x)))


@pytest.mark.parametrize("n", [3, 4, 5, 8, 12, 29, 48, 200, 3_000])
@pytest.mark.parametrize("rho", [0.0, 0.02, -0.2659, 0.5, 0.5546, -0.62, 0.6972, 0.9, 0.99])
def test_p_against_the_integral(n, rho):
    want = student_p(rho, n)
    assert stats.spearman_p(rho, n) == pytest.approx(want, rel=2e-4 if n > 3 else 5e-3, abs=1e-9)


def test_p_goldens():
    """From tables of Student's t: t = 2.306 at 8 degrees and 1.960 at very many is 0.05."""
    of_t = lambda t, n: t / math.sqrt(n - 2 + t * t)
    for t, n, p in ((2.306, 10, 0.05), (3.355, 10, 0.01), (12.706, 3, 0.05), (2.042, 32, 0.05), (1.96, 100_002, 0.05), (2.576, 100_002, 0.01)):
        assert stats.spearman_p(of_t(t, n), n) == pytest.approx(p, rel=2e-3)
    assert stats.spearman_p(1.0, 5) == 0 and math.isnan(stats.spearman_p(0.5, 2))


def test_json_parts(spark):
    tests = spark.createDataFrame([("m", "x", 0.1, 0.001)], "metric string, method string, mean_diff double, p_value double")
    summary = spark.createDataFrame([("x", "m", 0.5, 0.1, 9)], "method string, metric string, mean double, std double, n long")
    out = json.loads(reports.significance_json(tests, "ref", 1000, summary))
    assert out["n_resamples"] == 1000 and out["summary"] == {"x": {"m": {"mean": 0.5, "std": 0.1, "n": 9}}}
    matrix = spark.createDataFrame([(a, b, c, None) for a, b, c in (("x", "x", 1.0), ("y", "y", 1.0), ("x", "y", 0.2), ("y", "x", 0.2))], "a string, b string, cosine double, verdict string")
    got = json.loads(persona_report.distinctness_json(matrix, spark.createDataFrame([(1, "t")], "id int, output string")))
    assert got["records"] == [{"id": 1, "output": "t"}] and got["total_outputs"] == 1 and got["all_distinct"] is True
    with pytest.raises(ValueError, match="more than 1"):
        persona_report.distinctness_json(matrix, spark.range(2), most=1)


@pytest.mark.parametrize(("cosines", "verdict", "every"), [([0.2, 0.4, 0.1], "pass", True), ([0.2, 0.6, 0.1], "pass", False), ([0.2, 0.8, 0.1], "review", False), ([0.5, 0.6, 0.7], "review", False), ([], "review", False)])
def test_both_rules_of_distinctness(spark, cosines, verdict, every):
    matrix = spark.createDataFrame([("a", f"b{k}", c) for k, c in enumerate(cosines)], "a string, b string, cosine double")
    r = persona_report.distinctness_verdict(matrix).first()
    assert (r["verdict"], r["all_distinct"]) == (verdict, every)


def test_report_has_its_caveat(spark):
    columns = ["method", "available", *[c for c, _, _ in persona_report.CSV_COLUMNS], "cross_prompt_dispersion_n", "silhouette_n", "same_prompt_intra_std", "silhouette_std", "inter_std", "cross_prompt_dispersion_std"]
    row = spark.range(1).select(*[F.lit("m" if c == "method" else None).cast("string").alias(c) for c in dict.fromkeys(columns)])
    assert "**Caveat:**" in persona_report.report_markdown(row, "r")


def test_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("   ",), (" done.  ",), (" plain.\n",)], "t string")
    got = [(r["issues"][0] if r["issues"] else None, r["is_not_truncated"]) for r in df.select(*judge.gate(F.col("t"))).collect()]
    assert got[0][0] == "empty output" and got[1][1] and got[2][1]
    msgs = df.limit(3).select(F.array(F.struct(F.lit("user ").alias("role"), F.lit(" q ").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("content"))).alias("m"))
    assert [m["content"] for m in msgs.select(records.normalise_messages(F.col("m")).alias("m")).first()["m"]] == ["q", "a"]
    assert df.select(corpus.question_of(F.lit(" x ")).alias("q")).first()["q"] == "x"


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([("a", 0.00005), ("a", 0.00005), ("b", 0.00015), ("b", 0.00015)], "method string, score double")
    assert [r["mean"] for r in stats.score_table(df, ["a", "b"]).collect()] == [0.0, 0.0002]


def test_metadata_as_a_string(spark):
    df = spark.createDataFrame([('{"persona": "minimalist", "n": 3}',), ('{"a": 1} x',), ("[1]",), ("text",), (None,), (" {} ",)], "raw string")
    got = [r["m"] for r in df.select(records.metadata_object(F.col("raw")).alias("m")).collect()]
    assert got == [{"persona": "minimalist", "n": "3"}, None, None, None, None, {}]
    none = F.lit(None).cast("string")
    m = df.limit(1).select(records.metadata(records.metadata_object(F.col("raw")), none, none, none, F.lit("i7")).alias("m")).first()["m"]
    assert m == {"n": "3", "persona": "minimalist", "source_id": "i7"}


def test_training_text_and_longest(spark):
    m = spark.range(1).select(F.array(records.message("user", F.lit("q")), records.message("assistant", F.lit("a\nb"))).alias("m"))
    assert m.select(records.as_training_text(F.col("m")).alias("t")).first()["t"] == "[USER]\nq\n[ASSISTANT]\na\nb"
    df = spark.createDataFrame([("x", k, v) for k, v in enumerate([3, 9, 9, 1])] + [(None, 9, 5)], "persona string, k int, v int")
    got = sorted((str(r["persona"]), r["rank"], r["k"]) for r in metrics.top_by_persona(df, "v", "k", 2).collect())
    assert got == [("None", 1, 9), ("x", 1, 1), ("x", 2, 2)]


def test_evaluation_without_references_or_prompts(spark):
    gen = spark.createDataFrame([("m", "p", 1, "a b c", [1.0, 0.0]), ("m", "p", 2, "a b d", [0.0, 1.0])], "method string, prompt string, output_id int, output string, u array<double>")
    refs = spark.createDataFrame([], "ref_id int, ru array<double>")
    r = metrics.evaluate_outputs(gen, 2, refs, spark.createDataFrame([], "prompt string, pu array<double>"), ["method"]).first()
    assert r["corpus_novelty_mean"] is None and r["quality_proxy"] is None and r["sbert_pairwise_mean"] == 0 and r["distinct_1"] == pytest.approx(4 / 6)
    near = metrics.evaluate_outputs(gen, 2, spark.createDataFrame([(1, [1.0, 0.0])], "ref_id int, ru array<double>"), spark.createDataFrame([("p", [0.0, 1.0])], "prompt string, pu array<double>"), ["method"]).first()
    assert (near["corpus_novelty_mean"], near["corpus_novelty_min"], near["quality_proxy"]) == (0.5, 0.0, 0.5)
