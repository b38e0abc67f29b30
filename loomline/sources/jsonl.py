"""JSON-lines sources and sinks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, place of the lines that aren't blank. place: "line 7", or, in a part of a file
    that Spark has split, "line 7 after byte 134217728". Lines are numbered as they stream by."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return raw.mapInArrow(_number, "value string, file string, start long, line long").where(F.col("value").rlike(r"(?U)\S")).select(
        "value", "file", F.concat(F.lit("line "), F.col("line"), F.when(F.col("start") > 0, F.concat(F.lit(" after byte "), F.col("start"))).otherwise("")).alias("place")
    )


def _number(batches):
    at, line = None, 0
    for batch in batches:
        files, starts, lines = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
        for part in zip(files, starts, strict=True):
            line = line + 1 if part == at else 1
            at = part
            lines.append(line)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], names=[*batch.schema.names, "line"])


def _checked(spark: SparkSession, path: str | list[str], schema: str, check=None) -> DataFrame:
    """value, file, place, the schema's fields, and _why: what is wrong with the line, or null."""
    rows = _lines(spark, path).select("value", "file", "place", _parsed(schema).alias("r")).select("value", "file", "place", "r.*")
    # Spark's parser stops after the first value of a line. What follows it shows in the lengths of
    # lists around the line: only if the line is one value, and nothing else, are both 2.
    first, last = (F.json_array_length(F.concat(F.lit(a), F.col("value"), F.lit(b))) for a, b in (("[1,", "]"), ("[", ",1]")))
    whole = F.coalesce((first == 2) & (last == 2), F.lit(False))
    why = F.when(F.col("_bad").isNotNull() | ~whole, "invalid JSON object")
    if check is not None:
        why = why.when(~F.coalesce(check, F.lit(False)), "invalid row")
    return rows.withColumn("_why", why).drop("_bad")


def _holding(rows: DataFrame) -> DataFrame:
    """The rows, behind a filter that fails at a wrong line. A filter decides how many rows there
    are, so no optimiser can leave it out, whatever columns (or none) are asked for."""
    said = F.concat(F.lit("malformed line: "), F.col("_why"), F.lit(" in "), F.col("file"), F.lit(" "), F.col("place"), F.lit(": "), F.left("value", F.lit(200)))
    held = rows.where(F.when(F.col("_why").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    return held.drop("value", "file", "place", "_why")


def read_lenient(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Blank lines are skipped; a line that isn't an object of the schema fails every action on
    the result, counts and subsets of columns too, with its file and line. None is lost."""
    return _holding(_checked(spark, path, schema))


def read_split(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, dropped): lines that don't parse by the schema are dropped, and returned as
    (file, place, value)."""
    rows = _checked(spark, path, schema)
    return rows.where("_why is null").drop("value", "file", "place", "_why"), rows.where("_why is not null").select("file", "place", "value")


def _parsed(schema: str):
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    object_ = F.col("value").rlike(r"^\s*\{")
    return F.when(object_, row).otherwise(F.from_json(F.lit("{"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))


def read_strict(spark: SparkSession, path: str | list[str], schema: str, check=None) -> DataFrame:
    """Blank lines are skipped. A line that isn't an object of the schema (or for which
    `check`, a condition on the fields, doesn't hold) raises ValueError with its file and line
    number; so does input without a record. The lines are checked before anything is returned,
    and again whenever the result is read."""
    rows = _checked(spark, path, schema, check)
    if (bad := rows.where("_why is not null").select("_why", "file", "place", "value").first()) is not None:
        raise ValueError(f"{bad['_why']} in {bad['file']} {bad['place']}: {bad['value'][:200]}")
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return _holding(rows)


def parse_run(argument: str) -> tuple[str, str]:
    """LABEL=PATH."""
    label, found, path = argument.partition("=")
    if not found or not label.strip() or not path.strip():
        raise ValueError(f"not LABEL=PATH: {argument}")
    return label.strip(), path.strip()


def prompt_pool(spark: SparkSession, path: str, most: int, sentences: int = 0) -> DataFrame:
    """The first `most` user prompts of a file of chat records, in the order of its lines.

    Lines that don't parse, and records without a user turn, are passed over. sentences: a
    claim is cut to so many, if over 0. (place: the line's place in the file.)
    """
    schema = "messages array<struct<role:string,content:string>>"
    rows = spark.read.option("wholetext", False).text(path).withColumn("place", F.monotonically_increasing_id())
    text = F.filter(F.from_json("value", schema)["messages"], lambda m: m["role"] == "user")
    prompt = F.try_element_at(text, F.lit(1))["content"]
    own = rows.select("place", prompt.alias("prompt")).where("prompt is not null and prompt <> ''").orderBy("place").limit(most)
    return own.withColumn("prompt", T.truncate_claim(F.col("prompt"), sentences)) if sentences else own


def read_runs(spark: SparkSession, runs: dict[str, str] | list[str], schema: str) -> DataFrame:
    """Several runs, their labels a column. runs: a path by label, or LABEL=PATH arguments."""
    if not isinstance(runs, dict):
        runs = dict(map(parse_run, runs))
    out = None
    for label, path in runs.items():
        own = read_lenient(spark, path, schema).withColumn("run", F.lit(label))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no runs")
    return out


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pretty(rows: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small result as one indented JSON document on the driver."""
    got = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows; use write()")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(got, f, ensure_ascii=False, indent=2, default=str)
