import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.operators import cascade, diversity, judge, pairs, records, reports, stats
from loomline.sources import jsonl
from loomline.streaming import cascade_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("texts", "n", "want"), [(["alpha beta", "gamma delta"], 1, 1.0), (["cat cat", "cat cat"], 1, 0.25), (["cat dog", "cat dog"], 1, 0.5), (["word"], 2, 0.0), ([None, ""], 1, 0.0)])
def test_distinct_n(spark, texts, n, want):
    df = spark.createDataFrame([("g", t) for t in texts], "g string, t string")
    assert diversity.distinct_n(df, ["g"], "t", (n,)).first()[f"distinct_{n}"] == want


def bleu(cand, refs):
    if not cand or not refs:
        return 0.0
    smooth, logs = 1.0, 0.0
    for n in range(1, 5):
        grams = lambda t: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]  # noqa: E731, B023
        own = grams(cand)
        hit = sum(min(own.count(g), max(grams(r).count(g) for r in refs)) for g in set(own))
        if not own or not hit:
            smooth *= 2
            logs += math.log(1 / (smooth * (len(own) or max(1, len(cand)))))
        else:
            logs += math.log(hit / len(own))
    r = min((abs(len(x) - len(cand)), len(x)) for x in refs)[1]
    return math.exp(logs / 4) * (1 if len(cand) > r else math.exp(1 - r / len(cand)))


def test_self_bleu_against_formula(spark):
    groups = {"one": ["only one"], "same": ["the cat sat on the mat today"] * 2, "mixed": ["a b c d e a b", "a b c x", "q", "", "a b c d e f g h i", "a b c x"]}
    rows = [(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    got = {r["g"]: r["self_bleu"] for r in diversity.self_bleu(spark.createDataFrame(rows, "g string, k int, t string"), ["g"], "t", "k").collect()}
    for g, ts in groups.items():
        each = [bleu(t.split(), [x.split() for j, x in enumerate(ts) if j != k]) for k, t in enumerate(ts)]
        assert got[g] == pytest.approx(sum(each) / len(each))
    assert got["one"] == 0 and got["same"] > 0.9


def test_text_functions(spark):
    assert one(spark, T.tokens(lit("Hello, Wörld!"))) == ["hello", "wörld"]
    assert one(spark, T.repetitions(lit("Go go go go stop stop"))) == 1 and one(spark, T.repetitions(lit("go go go gopher"))) == 1
    assert one(spark, T.slug(lit("  What's -- up? ")))[:10] == "what_s_up"
    claim = T.CLAIM_PREFIX + " One. Two! Three?"
    assert one(spark, T.truncate_claim(lit(claim), 2)) == T.CLAIM_PREFIX + "One. Two!" and one(spark, T.truncate_claim(lit("A. B."), 1)) == "A. B."
    assert one(spark, T.link_ratio(lit("http://a.bc"))) == 1.0 and one(spark, T.link_ratio(lit(""))) == 0
    assert one(spark, T.code_ratio(lit("`ab` c"))) == pytest.approx(4 / 6) and one(spark, T.formula_ratio(lit("$x$"))) == pytest.approx(2 / 3)


@pytest.mark.parametrize(("n", "text", "want"), [(29, None, "response_too_short"), (30, None, None), (250, None, None), (251, None, "response_too_long"), (0, " \n", "empty_response"), (0, None, "empty_response"), (40, "[deleted]", "deleted_marker"), (40, "http://" + "x" * 400, "mostly_links")])
def test_reply_cascade_bounds(spark, n, text, want):
    body = " ".join(["w"] * n + ([text] if text else [])) if n else text
    df = spark.createDataFrame([(body,)], "reply string")
    assert cascade.with_reason(df, cascade.reply_rules(F.col("reply"))).first()["reason"] == want


def test_other_cascades(spark):
    w = lambda n: " ".join(["w"] * n)
    rows = [(w(4), w(80), None), (w(3), w(80), "title_too_short"), (w(41), w(80), "title_too_long"), (w(4), w(79), "abstract_too_short"), (w(4), w(251), "abstract_too_long"), (w(4), "$" * 90 + w(80), "formula_heavy"), ("", w(80), "empty_input")]
    df = spark.createDataFrame(rows, "t string, a string, want string")
    assert all(r["reason"] == r["want"] for r in cascade.with_reason(df, cascade.abstract_rules(F.col("t"), F.col("a"))).collect())
    rows = [(w(3), w(8), None, None), (w(3), w(8), 0.649, "low_quality"), (w(3), w(8), 0.65, None), (w(3), w(61), 0.9, "argument_too_long"), (w(2), w(8), 0.9, "topic_too_short")]
    df = spark.createDataFrame(rows, "t string, a string, wa double, want string")
    assert all(r["reason"] == r["want"] for r in cascade.with_reason(df, cascade.argument_rules(F.col("t"), F.col("a"), F.col("wa"))).collect())
    rows = [(w(20), w(40), None), (w(19), w(40), "question_too_short"), (w(20), "```" + w(40) + "```", "mostly_code"), (w(20), None, "empty_response")]
    df = spark.createDataFrame(rows, "q string, a string, want string")
    assert all(r["reason"] == r["want"] for r in cascade.with_reason(df, cascade.answer_rules(F.col("q"), F.col("a"))).collect())


@pytest.mark.parametrize("bucket", [1, 7, 4096])
def test_limited_keep(spark, bucket):
    df = spark.createDataFrame([(k, None if k % 3 else "bad") for k in range(100)], "k long, reason string")
    got = sorted(r["k"] for r in cascade.keep_limited(df, "k", 10, bucket_rows=bucket).collect())
    kept, want = 0, []
    for k in range(100):
        if kept >= 10:
            break
        want.append(k)
        kept += bool(k % 3)
    assert got == want


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("b", [2.0, 2.0]), ("c", [0.0, 0.0]), ("c", [1.0, 0.0]), ("d", [3.0, 1.0])]
    df = V.with_unit(spark.createDataFrame(rows, "g string, embedding array<float>"))
    got = {r["g"]: r["m"] for r in V.group_sums(df, ["g"], 2).select("g", V.mean_pairwise(F.col("n"), F.col("S"), F.col("q")).alias("m")).collect()}
    assert got == pytest.approx({"a": 0, "b": 1, "c": 0, "d": 0})
    assert {(r["a"], r["b"]) for r in reports.cross_group_matrix(df, "g", 2).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    s = reports.silhouette(df.withColumn("vec_id", F.monotonically_increasing_id()), "g", 2).select("g").collect()
    assert {r["g"] for r in s} == {"a", "b", "c"}


def test_pair_selection(spark):
    rows = [("p", k, t, q, r) for k, (t, q, r) in enumerate([("A", 0.85, 0.10), ("B", 0.80, 0.15), ("C", 0.70, 0.85), ("D", 0.10, 0.95)])]
    rows += [("same", 0, "x", 0.9, 0.5), ("same", 1, "x", 0.5, 0.1), ("few", 0, "y", 0.9, 0.1), ("few", 1, "z", 0.1, 0.9), ("tie", 2, "u", 0.5, 0.5), ("tie", 1, "v", 0.5, 0.5), ("tie", 0, "w", 0.4, 0.5)]
    df = spark.createDataFrame(rows, "g string, k int, text string, quality double, rarity double")
    got = {r["g"]: (r["chosen"]["text"], r["rejected"]["text"]) for r in pairs.select_pairs(df, ["g"], "k", 0.35, 0.4, 0.6).collect()}
    assert got == {"p": ("C", "A"), "tie": ("v", "w")}
    assert pairs.select_pairs(df.where("g = 'p'"), ["g"], "k", 0.35, 0.4, 0.6, min_margin=0.9).count() == 0
    m = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "g string, x double")
    assert sorted(r["s"] for r in pairs.with_minmax(m, "x", ["g"], "s").collect()) == [0.0, 0.5, 1.0, 1.0, 1.0, 1.0]
    for n, want in ((9, 0.0), (10, 0.6 + 0.4 * 0.1), (400, 0.6 + 0.4 * 0.25), (401, 0.0)):
        text = " ".join(f"w{k}" for k in range(n))
        assert one(spark, pairs.quality(lit(text))) == pytest.approx(want)


def test_records(spark):
    chain = lambda s, p, **k: one(spark, records.adapter_chain(lit(s), lit(p), **k))
    assert chain("base", None) == [] and chain("single", None) == ["single/all"] and chain("divpo", "minimalist") == ["sft/minimalist", "divpo/minimalist"]
    assert chain("divpo_v2_1p5b", "minimalist", sft_stage="sft_1p5b") == ["sft_1p5b/minimalist", "divpo_v2_1p5b/minimalist"]
    for bad in (("sft", None), ("bogus", "x")):
        with pytest.raises(Exception, match="stage"):
            chain(*bad)
    assert [m["role"] for m in one(spark, records.messages(lit("hi"), lit("sys")))] == ["system", "user"]
    assert one(spark, records.messages(lit("hi"), lit(None), True))[0]["content"] == T.CLAIM_PREFIX + "hi"
    legacy = records.lift_legacy(F.lit(None).cast(records.MESSAGE), lit("minimalist"), lit(" q "), lit("a"))
    assert [m["content"] for m in one(spark, legacy)] == [dims.SYSTEM_PROMPTS["minimalist"], "q", "a"]
    for persona, prompt, why in (("m", "q", "known persona"), (None, "q", "known persona"), ("minimalist", "  ", "messages, or a prompt")):
        with pytest.raises(Exception, match=why):
            one(spark, records.lift_legacy(F.lit(None).cast(records.MESSAGE), lit(persona), lit(prompt), lit("a")))
    df = spark.createDataFrame([("g", k, f"t{k}") for k in range(6)], "g string, k int, v string")
    got = {r["k"]: r["peers"] for r in records.peers(df, ["g"], "k", "v").collect()}
    assert got[0] == ["t1", "t2", "t3"] and got[2] == ["t0", "t1", "t3"] and got[5] == ["t0", "t1", "t2"]


@pytest.mark.parametrize("raw", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} there'])
def test_parse_object(spark, raw):
    assert one(spark, judge.number(judge.parse_object(lit(raw)), "a")) == 1.0


def test_judge(spark):
    assert one(spark, judge.parse_object(lit("none"))) is None and one(spark, judge.parse_object(lit("4"))) is None
    assert one(spark, judge.number(lit('{"a": "4", "b": true}'), "a")) is None and one(spark, judge.number(lit('{"b": true}'), "b")) == 1.0
    assert one(spark, judge.mean_of(F.lit(5.0), F.lit(None).cast("double"), F.lit(3.0))) == 4.0
    assert one(spark, judge.render("{p}|{o}", p=lit("{o}"), o=lit("x"))) == "{o}|x"
    assert one(spark, judge.numbered_peers(F.array(lit("first"), lit("second")))) == "1. first\n2. second"
    with pytest.raises(ValueError):
        judge.render("{prompt}")
    good, bad = "However, this claim ignores the cost that all the towns have to pay.", "This is a fine claim and I support it in full today."
    g = lambda t: spark.range(1).select(*judge.gate(lit(t))).first()
    assert g(good)["passes_gate"] and g(bad)["issues"] == ["missing counter-argument signal"] and "empty output" in g("")["issues"]


def test_cache_is_asked_once(spark, tmp_path):
    wanted = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("b", "pb")], "k string, prompt string")
    cache = spark.createDataFrame([("a", "old")], "k string, response string")
    asked, path = str(tmp_path / "asked"), str(tmp_path / "cache")

    def call(prompts):
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    got, new = judge.score_with_cache(wanted, cache, ["k"], "prompt", call, path)
    for _ in range(2):
        assert sorted(r["response"] for r in got.collect()) == ["PB", "PB", "old"] and new.count() == 1
    assert open(asked).read() == "pb\n"
    kept = judge.read_cache(spark, path, "k string, response string")
    again, none = judge.score_with_cache(wanted.where("k = 'b'"), kept, ["k"], "prompt", call, path)
    assert {r["response"] for r in again.collect()} == {"PB"} and none.count() == 0 and open(asked).read() == "pb\n"
    with pytest.raises(Exception, match="1 answers to 2 prompts|0 answers"):
        judge.score_with_cache(wanted, cache.limit(0), ["k"], "prompt", lambda prompts: prompts[1:], path)


def test_judge_all(spark, tmp_path):
    out = spark.createDataFrame([("1", "m", "p", "x", "one"), ("2", "m", "p", None, "two")], "output_id string, method string, prompt string, persona string, output string")
    call = lambda prompts: ['Here: {"novelty": 4}' if p.startswith("N") else '```json\n{"persona_fidelity": 2}\n```' for p in prompts]
    rubrics = {"novelty": "N {prompt} {output}", "persona_fidelity": "F {persona} {output}"}
    for _ in range(2):
        got = {r["output_id"]: r for r in judge.judge_all(out, rubrics, call, str(tmp_path / "c")).collect()}
    assert got["1"]["persona_fidelity"] == '{"persona_fidelity": 2}' and got["2"]["persona_fidelity"] is None and got["2"]["novelty"] == '{"novelty": 4}'
    assert judge.read_cache(spark, str(tmp_path / "c"), "output_id string, rubric string, response string").count() == 3


def test_stats(spark):
    obs = [("a", str(k), "m", 0.1) for k in range(5)] + [("b", str(k), "m", 0.9) for k in range(5)]
    specs = spark.createDataFrame([("m", True)], "metric string, lower_is_better boolean")
    diffs = stats.paired_differences(spark.createDataFrame(obs, "method string, prompt string, metric string, value double"), "a", specs)
    r = stats.bootstrap(diffs, 50).first()
    assert r["mean_diff"] == pytest.approx(0.8) and r["p_value"] == 0 and r["p_loss"] == 1 and r["n"] == 5
    v = reports.verdicts(stats.bootstrap(diffs.withColumn("diff", -F.col("diff")), 50)).first()
    assert (v["better"], v["worse_reference"], v["worse"]) == ("", "", "m")
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 4.0), ("g", 3.0, 9.0), ("h", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    s = {r["g"]: (r["n"], r["rho"], r["interpretation"]) for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert s["g"] == (3, pytest.approx(1.0), "strong") and s["h"][2] == "insufficient" and s["c"][1] is None
    assert stats.spearman_p(0.5, 20) == pytest.approx(0.0248, abs=2e-3)


def test_tables_and_classes(spark):
    df = spark.createDataFrame([("base", "self_bleu", 0.5), ("mixture_divpo", "self_bleu", 0.2)], "method string, metric string, mean double")
    md = reports.markdown_table(df, dims.METHODS)
    assert "Self-BLEU ↓" in md and "0.200" in md and "—" in md
    assert reports.csv_table(df, ["base"]).split("\n") == ["method,self_bleu", "base,0.5000"]
    assert [one(spark, reports.classify(F.lit(x))) for x in (0.49, 0.5, 0.7)] == ["distinct", "borderline", "mode-collapsed"]


def test_jsonl_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "a.json"
    f.write_text('{"reply": "' + "w " * 40 + '"}\n\n{"reply": "short"}\n')
    assert jsonl.read_strict(spark, str(f), "reply string").count() == 2 == jsonl.read_lenient(spark, str(f), "reply string").count()
    bad = tmp_path / "bad.json"
    bad.write_text('{"reply": "x"}\n[1]\n')
    with pytest.raises(Exception, match="invalid JSON object"):
        jsonl.read_strict(spark, str(bad), "reply string").collect()
    rows = cascade_stream.filtered(spark, str(tmp_path / "in"), "reply string", lambda df: cascade.reply_rules(F.col("reply")))
    cascade_stream.start(rows, str(tmp_path / "kept"), str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "kept")).count() == 1
    assert {r["reason"]: r["n"] for r in spark.read.json(str(tmp_path / "counts")).collect()} == {"kept": 1, "response_too_short": 1}
