"""The keyed cache: concurrent and killed writers, compaction."""

import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from loomline.operators import judge

KEY, VALUE = "id string, rubric string", "response string"


def cache(spark, path):
    return judge.AnswerCache(spark, str(path), KEY, VALUE)


def rows(c):
    return sorted(map(tuple, c.read().collect()), key=str)


def frame(spark, items):
    return spark.createDataFrame(items, f"{KEY}, {VALUE}")


def test_the_latest_answer_of_a_key_counts(spark, tmp_path):
    c = cache(spark, tmp_path / "c")
    assert rows(c) == [] and c.compact() == 0 and c.sweep() == 0
    assert sorted(map(tuple, c.add(frame(spark, [("a", "q", "1"), ("b", "q", "2"), ("b", "q", "3")])).collect())) == [("a", "q", "1"), ("b", "q", "3")]
    c.add(frame(spark, [("a", "q", "9"), (None, "q", "4")]))
    want = [("a", "q", "9"), ("b", "q", "3"), (None, "q", "4")]
    assert rows(c) == sorted(want, key=str)
    assert c.compact() == 2 and len(c.batches()) == 1 and rows(c) == sorted(want, key=str)
    c.add(frame(spark, [("b", "q", "0")]))
    assert dict((r[0], r[2]) for r in rows(c)) == {"a": "9", "b": "0", None: "4"}
    assert judge.read_cache(spark, str(tmp_path / "c"), f"{KEY}, {VALUE}").count() == 3


def test_two_writers_at_once_and_a_killed_one(spark, tmp_path):
    path, wanted = tmp_path / "c", spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit("q").alias("rubric"), F.concat(F.lit("p"), "id").alias("prompt"))
    got, gate = {}, threading.Barrier(2)

    def run(name):
        known = judge.read_cache(spark, str(path), f"{KEY}, {VALUE}")
        gate.wait()  # both have seen the same misses
        scored, _ = judge.score_with_cache(wanted, known, ["id", "rubric"], "prompt", lambda prompts: [f"{name} {p}" for p in prompts], str(path))
        got[name] = scored.count()

    threads = [threading.Thread(target=run, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {"one": 40, "two": 40}
    c = cache(spark, path)
    # A writer that was killed: files, but no mark that they are complete.
    left = path / "batch-99999999999999999999-killed"
    shutil.copytree(path / c.batches()[0], left)
    os.remove(left / "_SUCCESS")
    again, new = judge.score_with_cache(wanted, c.read(), ["id", "rubric"], "prompt", lambda prompts: 1 / 0, str(path))
    assert again.count() == 40 == again.select("id").distinct().count() and new.count() == 0
    assert c.read().count() == 40 and c.read().select(F.split("response", " ")[0].alias("w")).distinct().count() == 1
    before = rows(c)
    assert c.compact() >= 2 and rows(c) == before and left.exists()
    assert c.sweep(older_than=-1.0) == 1 and not left.exists() and rows(c) == before


def test_a_failed_scorer_leaves_no_batch(spark, tmp_path):
    wanted = frame(spark, [("a", "q", "p")]).withColumnRenamed("response", "prompt")
    with pytest.raises(Exception, match="0 answers to 1 prompts"):
        judge.score_with_cache(wanted, cache(spark, tmp_path / "c").read(), ["id", "rubric"], "prompt", lambda prompts: [], str(tmp_path / "c"))
    assert cache(spark, tmp_path / "c").batches() == []


def test_a_compaction_cut_short(spark, tmp_path):
    c = cache(spark, tmp_path / "c")
    for k in range(3):
        c.add(frame(spark, [("a", "q", str(k)), (str(k), "q", "x")]))
    names, kept = c.batches(), tmp_path / "kept"
    shutil.copytree(tmp_path / "c", kept)
    want = rows(c)
    c.compact()
    for n in names[1:]:  # it was killed after it had deleted one of them
        shutil.copytree(kept / n, tmp_path / "c" / n)
    assert rows(c) == want
    c.add(frame(spark, [("a", "q", "new")]))
    c.compact()
    assert dict((r[0], r[2]) for r in rows(c))["a"] == "new"
