import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.operators import cascade, coauthor, metrics, pairs, persona_report, records, reports, stats
from loomline.sources import jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- sources
def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_lenient_loses_nothing(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"a": 1}', "", "  ", '{"a": 2, "b": "x"}')
    assert sorted(r["a"] for r in jsonl.read_lenient(spark, good, "a int, b string").collect()) == [1, 2]
    bad = write(tmp_path / "b.jsonl", '{"a": 1}', '{"a": ', '{"a": 3}')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_lenient(spark, bad, "a int").collect()
    kept, dropped = jsonl.read_split(spark, bad, "a int")
    assert sorted(r["a"] for r in kept.collect()) == [1, 3] and [r["value"] for r in dropped.collect()] == ['{"a": ']


@pytest.mark.parametrize(("line", "why"), [('{"a": ', "invalid JSON object"), ("[1]", "invalid JSON object"), ('{"a": "text"}', "invalid JSON object"), ('{"a": -1}', "invalid row")])
def test_strict_names_the_line(spark, tmp_path, line, why):
    path = write(tmp_path / "c.jsonl", '{"a": 1}', "", line, '{"a": 3}')
    with pytest.raises(ValueError, match=rf"{why} in .*c.jsonl line 3"):
        jsonl.read_strict(spark, path, "a int", F.col("a") > 0)
    fine = write(tmp_path / "d.jsonl", '{"a": 1}', "", '{"a": 3}')
    assert sorted(r["a"] for r in jsonl.read_strict(spark, fine, "a int", F.col("a") > 0).collect()) == [1, 3]
    with pytest.raises(ValueError, match="no records"):
        jsonl.read_strict(spark, write(tmp_path / "e.jsonl", "", " "), "a int")


def test_runs_and_prompt_pool(spark, tmp_path):
    a, b = write(tmp_path / "a", '{"x": 1}'), write(tmp_path / "b", '{"x": 2}')
    assert {(r["run"], r["x"]) for r in jsonl.read_runs(spark, [f"one={a}", f"two={b}"], "x int").collect()} == {("one", 1), ("two", 2)}
    for bad in ("one", "=x", "x="):
        with pytest.raises(ValueError, match="LABEL=PATH"):
            jsonl.parse_run(bad)
    turn = lambda role, text: {"role": role, "content": text}
    rows = [json.dumps({"messages": m}) for m in ([turn("system", "s"), turn("user", T.CLAIM_PREFIX + "One. Two. Three.")], [turn("assistant", "a")], [turn("user", "second"), turn("user", "x")], [turn("user", "third")])]
    path = write(tmp_path / "p.jsonl", rows[0], "{broken", *rows[1:])
    assert [r["prompt"] for r in jsonl.prompt_pool(spark, path, 2, sentences=2).collect()] == [T.CLAIM_PREFIX + "One. Two.", "second"]
    assert jsonl.prompt_pool(spark, path, 9).count() == 3


def test_pretty_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("ü", 1)], "a string, b int")
    jsonl.write(df, str(tmp_path / "out"))
    assert jsonl.read_lenient(spark, str(tmp_path / "out"), "a string, b int").collect() == df.collect()
    jsonl.write_pretty(df, str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json", encoding="utf-8")) == [{"a": "ü", "b": 1}]
    with pytest.raises(ValueError):
        jsonl.write_pretty(df.union(df), str(tmp_path / "x.json"), limit=1)


# --- records
def test_metadata_precedence(spark):
    lit = lambda x: F.lit(x).cast("string")
    raw = F.create_map(F.lit("persona"), F.lit("meta"), F.lit("source"), F.lit(" s "), F.lit("k"), F.lit(" "), F.lit("n"), F.lit(" 1 "))
    m = lambda *a, **k: one(spark, records.metadata(*a, **k))
    assert m(raw, lit(None), lit(None), lit(None), F.lit(7)) == {"persona": "meta", "source": "s", "source_id": "7", "n": "1"}
    assert m(raw, lit("col"), lit("own"), lit("id"), F.lit(7), given="arg") == {"persona": "arg", "source": "own", "source_id": "id", "n": "1"}
    assert m(F.lit(None).cast("map<string,string>"), lit(""), lit(None), lit(None), lit(None)) == {}


def test_personas_and_known_values(spark):
    assert one(spark, records.of_persona(F.lit(None).cast("string"), {"a": "x"})) is None and one(spark, records.of_persona(F.lit("a"), {"a": "x"})) == "x"
    with pytest.raises(Exception, match="unknown persona"):
        one(spark, records.of_persona(F.lit("b"), {"a": "x"}))
    df = spark.createDataFrame([("a",), (None,)], "method string")
    assert records.known_only(df, "method", ["a"], nulls=True).count() == 2
    with pytest.raises(Exception, match="unknown method"):
        records.known_only(df, "method", ["a"]).collect()
    assert records.overlay({"a": "1", "b": "2"}, ["b=x=y"]) == {"a": "1", "b": "x=y"}
    for bad in ("c=1", "a"):
        with pytest.raises(ValueError):
            records.overlay({"a": "1"}, [bad])
    assert [one(spark, records.as_text(F.lit(x), text=False)) for x in (0, False, 5)] == ["", "", "5"] and one(spark, records.as_text(F.lit(" 0\u00a0"))) == "0"


def test_unions_and_orders(spark):
    a = spark.createDataFrame([(k,) for k in range(20)], "id int")
    u = records.union_personas({"x": a, "y": a.limit(3)}, seed=42, key="id")
    first = [r["id"] for r in u.collect()]
    assert first == [r["id"] for r in records.union_personas({"x": a, "y": a.limit(3)}, 42, "id").collect()] and first != sorted(first) and u.where("persona = 'y'").count() == 3
    assert [r["id"] for r in metrics.shuffled(a, "id", 1).collect()] != [r["id"] for r in metrics.shuffled(a, "id", 2).collect()]
    rows = spark.createDataFrame([("r", "m", p) for p in ("zed", "minimalist", "abc", "contrarian")], "run string, method string, persona string")
    assert [r["persona"] for r in rows.orderBy(*metrics.report_order()).collect()] == ["contrarian", "minimalist", "abc", "zed"]


def test_no_break_space_ends_words(spark):
    assert one(spark, T.n_words(F.lit("a\u00a0b\u2003c"))) == 3 and one(spark, T.is_empty(F.lit("\u00a0 ")))


# --- metrics and reports
GEN = "method string, prompt string, persona string, output_id int, output string, embedding array<double>"


def generations(spark, rows):
    return V.with_unit(spark.createDataFrame([(*r[:3], k, r[3], r[4]) for k, r in enumerate(rows)], GEN)).withColumn("v", F.col("embedding"))


def test_persona_report_toy(spark):
    rows = [("base", "p", None, "a b", [1.0, 0.0]), ("base", "p", None, "c d", [0.0, 1.0]), ("po", "p", "contrarian", "x", [1.0, 0.0]), ("po", "p", "minimalist", "y", [0.0, 1.0]), ("po", "q", "contrarian", "x", [1.0, 0.0]), ("po", "q", "minimalist", "y", [1.0, 0.0])]
    rep = persona_report.persona_diversity(generations(spark, rows), 2, "output_id")
    got = {(r["method"], r["section"], r["key"]): (r["mean"], r["std"], r["n"]) for r in rep.collect()}
    assert got["base", "intra", None] == (pytest.approx(1.0), 0.0, 1) and got["base", "intra_persona", "none"][2] == 1
    assert got["po", "inter", None][0] == pytest.approx(0.5) and got["po", "inter", None][2] == 2
    assert got["po", "ratio", None] == (pytest.approx(1.0), 0.0, 1) and got["po", "intra", None] == (None, None, 0)
    assert ("po", "inter_pair", "contrarian__minimalist") in got and got["base", "inter", None] == (None, None, 0)
    wide = persona_report.wide(rep)
    csv = persona_report.report_csv(wide, "r").split("\n")
    assert csv[0].startswith("run,method,inter_mean,inter_std,inter_n,base_ratio_mean") and csv[1].startswith("r,base,,,0,,,1.000000,1") and len(csv[0].split(",")) == 12
    md = persona_report.report_markdown(wide, "r")
    assert "| po | — | — | 0 | no |" in md and md.count("| Method |") == 4
    both = wide.withColumn("run", F.lit("a")).union(wide.withColumn("run", F.lit("b")))
    assert persona_report.report_csv(both, "", compare=True).count("\n") == 5 and "| b | po |" in persona_report.comparison_markdown(both)


def test_distinctness_toy(spark):
    rows = [("m", p, g, "t", v) for p in "ab" for g, v in (("x", [1.0, 0.0]), ("y", [0.0, 1.0])) for _ in range(2)]
    m = persona_report.distinctness(generations(spark, rows), "persona", ["prompt"], 2)
    assert {(r["a"], r["b"]): r["cosine"] for r in m.collect()} == {("x", "x"): 1.0, ("y", "y"): 1.0, ("x", "y"): 0.0, ("y", "x"): 0.0}
    assert json.loads(persona_report.distinctness_json(m))["verdict"] == "pass" and persona_report.pair_findings(m).first()["verdict"] == "distinct"


def test_judge_scalars_and_last_row(spark):
    scored = spark.createDataFrame([("m", "p", '{"relevance": 5, "coherence": 4, "substance": 3}', None), ("m", "p", '{"relevance": 2, "coherence": "2", "substance": 2}', None)], "method string, prompt string, quality string, novelty string")
    assert [(r["metric"], r["value"]) for r in metrics.per_prompt_judged(scored).collect()] == [("quality", 3.0)]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z"), ("", 4, "z")], "output_id string, at int, v string")
    assert [tuple(r) for r in metrics.last_judgement(rows, "at").collect()] == [("a", 2, None)]


def test_breakdown_files(spark):
    gen = generations(spark, [("m", "p", "minimalist", "a b c", [1.0, 0.0]), ("m", "q", "minimalist", "d e f", [0.0, 1.0]), ("m", "q", None, "z", [0.0, 1.0])])
    judged = spark.createDataFrame([(0, 1, '{"novelty": 2}'), (0, 2, '{"novelty": 4}')], "output_id int, at int, novelty string").withColumns({r: F.lit(None).cast("string") for r in ("quality", "utility", "persona_fidelity")})
    rows = metrics.breakdown(gen, judged, "at", 2, "run")
    r = rows.first()
    assert (r["n_outputs"], r["novelty"], r["novelty_n"], r["quality"], r["sbert_distance"]) == (2, 4.0, 1, None, 1.0)
    csv = reports.breakdown_csv(rows).split("\n")
    assert len(csv[0].split(",")) == 17 and csv[1].startswith("run,m,minimalist,2,") and "| — |" in reports.breakdown_markdown(rows)


def test_stats_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None)], "method string, score double")
    assert [tuple(r) for r in stats.score_table(df, ["b", "a"]).collect()] == [("b", 5.0, None, 1), ("a", 1.5, 0.7071, 2)]
    assert "| b | 5.0000 | — | 1 |" in reports.score_markdown(df, ["b", "a"])
    got = stats.with_empty(stats.summarise(df, ["method"], "score"), df, ["method"])
    assert {r["method"]: (r["mean"], r["std"], r["n"]) for r in got.collect()}["c"] == (None, None, 0)
    pairs_ = spark.createDataFrame([(float(k), float(k * k), float(-k)) for k in range(6)] + [(None, 1.0, 1.0)], "x double, y double, z double")
    s = {r["rubric"]: r for r in stats.spearman_by(pairs_, {"q": ("x", "y"), "n": ("x", "z")}).collect()}
    assert (s["q"]["n"], s["q"]["rho"], s["q"]["p"]) == (6, 1.0, 0.0) and s["n"]["rho"] == -1.0 and s["n"]["interpretation"] == "weak"
    assert stats.spearman_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    tests = spark.createDataFrame([("m", "x", 0.1, 0.001)], "metric string, method string, mean_diff double, p_value double")
    assert json.loads(reports.significance_json(tests, "ref"))["comparisons"][0]["p_value"] == 0.001


def test_filter_totals(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), (None,), ("b",)], "reason string")
    t = cascade.totals(df).first()
    assert (t["total_seen"], t["total_kept"], t["total_filtered"], t["filter_counts"]) == (5, 2, 3, {"a": 2, "b": 1})
    assert tuple(cascade.totals(df.limit(0)).first())[:3] == (0, 0, 0)


# --- pairs
def test_external_quality_and_records(spark, tmp_path):
    df = spark.createDataFrame([(g, k, f"{g}{k}", "ask") for g in "xy" for k in (1, 0)], "g string, doc_id int, text string, prompt string")
    calls = str(tmp_path / "calls")

    def scorer(prompt, texts):
        with open(calls, "a") as f:
            f.write(f"{prompt}:{','.join(texts)}\n")
        return [{"0": 0.9, "1": 0.6}[t[1]] for t in texts]

    scored = pairs.with_quality(df, ["g"], scorer).withColumn("rarity", F.lit(0.12345))
    rows = pairs.select_pairs(scored, ["g"], "doc_id", 0.5, 1.0, 0.0)
    got = pairs.pair_records(rows, F.col("g"), F.lit("minimalist"), (1.0, 0.0), 0.5, 0.0, F.col("n"), True, "reward_model").orderBy("prompt").collect()
    assert [(r["chosen"], r["rejected"]) for r in got] == [("x0", "x1"), ("y0", "y1")] and got[0]["metadata"]["chosen_rarity"] == 0.1235 and got[0]["metadata"]["cross_persona"]
    assert sorted(set(open(calls).read().split())) == ["ask:x0,x1", "ask:y0,y1"]
    with pytest.raises(Exception, match="1 scores for 2"):
        pairs.with_quality(df, ["g"], lambda p, t: [0.5]).collect()
    reports.append_pair_examples(pairs.pair_records(rows, F.col("g"), F.lit("m"), (1.0, 0.0), 0.5, 0.0, F.col("n"), True), "prompt", "Pairs", str(tmp_path / "x.md"))
    assert "**chosen** (quality 0.9000, rarity 0.1235)" in open(tmp_path / "x.md").read()
    why = pairs.skip_reason(scored.withColumn("text", F.lit("same")), ["g"], 0.5, 1.0, 0.0, "doc_id").collect()
    assert {r["reason"] for r in why} == {"identical_text"} and pairs.skip_reason(scored, ["g"], 0.8, 1.0, 0.0, "doc_id").first()["reason"] == "few_eligible"


def test_quality_with_relevance(spark):
    t = F.lit(" ".join(f"w{k}" for k in range(50)))
    assert one(spark, pairs.quality(t, F.lit(0.8))) == pytest.approx(0.5 * 0.8 + 0.3 + 0.2 * 0.5)
    assert one(spark, pairs.quality(t, F.lit(-0.5))) == pytest.approx(0.3 + 0.2 * 0.5) and one(spark, pairs.quality(F.lit("nine words"), F.lit(1.0))) == 0


# --- briefs and cards
def test_briefs_cards_sessions(spark):
    none = F.lit(None)
    assert one(spark, coauthor.brief_text(F.lit("T"), F.lit("G"), none.cast("string"), F.array(F.lit("a"), F.lit("b")))) == "Topic: T\nWriter goal: G\nAudience: general readers\nConstraints: a; b"
    with pytest.raises(Exception, match="brief needs a goal"):
        one(spark, coauthor.brief_text(F.lit("T"), F.lit(""), none.cast("string"), none.cast("array<string>")))
    assert one(spark, coauthor.operation(F.lit(None).cast("string"))) == "synthesize_angles" and set(one(spark, coauthor.card(F.lit("minimalist"), F.lit("t"), F.lit("s"))).asDict()) == set(coauthor.CARD_FIELDS)
    turns = spark.createDataFrame([("s", 0, "u0", "a0", "art"), ("s", 1, "u1", "a1", "art")], "k string, t int, u string, a string, p string")
    got = {r["t"]: [(m["role"], m["content"]) for m in r["messages"]] for r in coauthor.session(turns, "k", "t", "u", "a", "p").collect()}
    assert got[0] == [("user", "art\n\nu0")] and got[1] == [("user", "art\n\nu0"), ("assistant", "a0"), ("user", "u1")]
    assert coauthor.source_registry(spark, [("minimalist", "arguments", "local")]).count() == 1 and set(coauthor.OPERATIONS) == set(dims.PERSONAS)
