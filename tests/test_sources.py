"""Readers that pruning can't bypass, and the early stop over files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import cascade
from loomline.sources import jsonl
from loomline.sources.scratch import files_of


@pytest.mark.parametrize("bad", ['{"a": ', "[1]", '"x"', '{"a": "text", "b": 1}', '{"a": 1}{"a": 2}', '{"a": 1} x', '{"a": 1}]', '{"a": 1}, 2] }'])
@pytest.mark.parametrize(
    "use",
    [lambda r: r.collect(), lambda r: r.count(), lambda r: r.select(F.lit(1)).collect(), lambda r: r.select("b").collect(), lambda r: r.agg(F.count(F.lit(1))).collect(), lambda r: r.groupBy("b").count().collect(), lambda r: r.isEmpty() or r.count()],
)
def test_a_malformed_line_fails_every_action(spark, tmp_path, bad, use):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(['{"a": 1, "b": "p"}', "", "  ", '{"a": 2, "b": "q"}', bad, '{"a": 3, "b": "r"}']) + "\n")
    if bad != '{"a": ' and use.__code__.co_names != ("count",):
        return  # every action on one of them, and one action on each
    with pytest.raises(Exception, match=r"invalid JSON object in file:.*x\.jsonl line 5: "):
        use(jsonl.read_lenient(spark, str(path), "a int, b string"))


def test_lines_of_several_files_and_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        for f in range(3):
            (tmp_path / f"{f}.jsonl").write_text("".join(json.dumps({"a": k}) + "\n" * (1 + k % 2) for k in range(100)))
        assert jsonl.read_lenient(spark, str(tmp_path), "a int").count() == 300
        (tmp_path / "1.jsonl").write_text("".join(('{"a": 0' if k == 70 else json.dumps({"a": k})) + "\n" for k in range(100)))
        text = (tmp_path / "1.jsonl").read_text()
        with pytest.raises(Exception, match=r"1\.jsonl line \d+ after byte \d+: \{\"a\": 0$|1\.jsonl line \d+ after byte \d+") as why:
            jsonl.read_lenient(spark, str(tmp_path), "a int").count()
        line, byte = map(int, __import__("re").search(r"line (\d+) after byte (\d+)", str(why.value)).groups())
        start = text.index("\n", byte) + 1  # a split begins with the first line that begins after its byte
        assert text[start:].split("\n")[line - 1] == '{"a": 0'
        kept, dropped = jsonl.read_split(spark, str(tmp_path), "a int")
        assert kept.count() == 299 and [r["value"] for r in dropped.collect()] == ['{"a": 0']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written_files(spark, tmp_path, n, rows, keep):
    """n text files of `rows` lines each; keep(i) lines of the table are long enough."""
    r, lines = random.Random(1), []
    for k in range(n * rows):
        lines.append(f"{k} " + "w " * (30 if keep(k) else r.randrange(3)))
    for f in range(n):
        (tmp_path / f"part {f:03d}.txt").write_text("\n".join(lines[f * rows : (f + 1) * rows]) + "\n")
    return lines


@pytest.mark.parametrize("limit", [0, 1, 20, 57, 10_000])
def test_early_stop_reads_what_it_needs(spark, tmp_path, limit):
    lines = written_files(spark, tmp_path, 40, 30, lambda k: k % 7 == 3)
    files = files_of(spark, f"file://{tmp_path}", ".txt")
    rules = [("short", F.size(F.split("value", " ")) < 20)]
    rows, report = cascade.keep_first(spark, files, lambda some: spark.read.text(some), rules, limit)
    seen, want = 0, []
    for line in lines:
        if seen == limit:
            break
        ok = len(line.split(" ")) >= 20
        want.append((line, None if ok else "short"))
        seen += ok
    assert sorted(map(tuple, rows.select("value", "reason").collect()), key=str) == sorted(want, key=str)
    need = -(-len(want) // 30)
    assert report["files"] == 40 and report["kept"] == min(limit, sum(k % 7 == 3 for k in range(1_200)))
    assert report["files_read"] <= max(need, min(40, 2 * need))
    counts = {r["reason"]: r["n"] for r in cascade.reason_counts(rows).collect()}
    assert counts.get("kept", 0) == report["kept"]


def test_early_stop_leaves_later_files_alone(spark, tmp_path):
    written_files(spark, tmp_path, 6, 50, lambda k: True)
    read = []

    def reader(some):
        read.extend(some)
        return spark.read.text(some)

    files = [*files_of(spark, f"file://{tmp_path}", ".txt")[:2], "file:///no/such/file"]
    rows, report = cascade.keep_first(spark, files, reader, [], 60)
    assert rows.count() == 60 and report["files_read"] == 2 and "file:///no/such/file" not in read
    assert cascade.keep_first(spark, [], reader, [], 5)[1]["files_read"] == 0
    with pytest.raises(ValueError, match="limit"):
        cascade.keep_first(spark, files, reader, [], -1)
