"""Hysteresis by composed maps against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import routing


def fold(turns, names, margin):
    """turns: sorted (order, scores)."""
    now, out = None, []
    for o, s in turns:
        s = [round(x or 0.0, 9) for x in s]
        best = s.index(max(s))
        if now is None or round(max(s) - s[now], 9) > margin:
            now = best
        out.append((o, names[now]))
    return out


@pytest.mark.parametrize(("segment", "parts"), [(2, 3), (3, 1), (7, 8), (4096, 8)])
def test_equals_the_fold(spark, segment, parts):
    r = random.Random(segment)
    names, rows = ["a", "b", "c"], []
    for g, n in (("long", 300), ("short", 1), (None, 40), ("", 9), *[(f"g{k}", r.randrange(1, 12)) for k in range(30)]):
        rows += [(g, o // 2 if g == "short" else o, *[r.choice([None, 0.0, 0.1, 0.14, 0.15, 0.3, 0.3500000001, 0.9]) for _ in names]) for o in range(n)]
    df = spark.createDataFrame(rows, "conv string, turn int, a double, b double, c double").repartition(parts)
    got = {}
    for x in routing.hysteresis(df, "conv", "turn", {n: F.col(n) for n in names}, 0.05, segment).collect():
        got.setdefault(x["conv"], []).append((x["turn"], x["persona"]))
    by = {}
    for g, o, *s in rows:
        by.setdefault(g, []).append((o, s))
    assert set(got) == set(by)
    for g, turns in by.items():
        assert sorted(got[g]) == sorted(fold(sorted(turns), names, 0.05)), g


def test_a_conversation_of_five_million_turns(spark):
    """No plan step holds the group; equal to the fold, which a plain loop makes here."""
    n = 5_000_000
    score = lambda k: (F.pmod(F.xxhash64("turn", F.lit(k)), F.lit(1000)) / 1000.0)
    df = spark.range(n).select(F.lit("one").alias("conv"), F.col("id").alias("turn")).withColumn("a", score(1)).withColumn("b", score(2))
    out = routing.hysteresis(df, "conv", "turn", {"a": F.col("a"), "b": F.col("b")}, 0.3, 1024)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # 4,883 segments are cut into segments again; the only list is of the at most 1,024 of these.
    assert "Window" not in plan and plan.count("collect_list") == 1
    table = df.join(out.select("turn", "persona"), "turn").select("turn", "a", "b", "persona").toPandas().sort_values("turn")
    assert len(table) == n
    now, wrong = None, 0
    for a, b, p in zip(table["a"].tolist(), table["b"].tolist(), table["persona"].tolist()):
        best = "a" if a >= b else "b"
        if now is None or round(max(a, b) - (a if now == "a" else b), 9) > 0.3:
            now = best
        wrong += p != now
    assert wrong == 0
