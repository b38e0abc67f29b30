"""Judging: rubric prompts, tolerant parsing, scalars, the counter-argument gate, cache."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.functions import dims
from loomline.functions import text as T

#: What stands for no peers, and (in gate) the names of issues.
NO_PEERS = "(no other arguments available)"


def render(template: str, **fields: Column) -> Column:
    """The template with each {field} replaced; user text is put in last, so that braces
    in it aren't expanded again. A null field that the template needs is an error."""
    import re

    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if re.fullmatch(r"\{\w+\}", piece) else None
        if name is None:
            parts.append(F.lit(piece))
        elif name in fields:
            parts.append(F.coalesce(fields[name], F.raise_error(F.lit(f"rubric needs {name}")).cast("string")))
        else:
            raise ValueError(f"rubric needs {name}")
    return F.concat(*parts)


def numbered_peers(peers: Column) -> Column:
    lines = F.transform(peers, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    return F.when(F.size(peers) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_PEERS))


def parse_object(raw: Column) -> Column:
    """JSON object of a judge's reply as a string: fences are stripped, else the text from
    the first { to the last } is taken; null where there is no object."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"(?im)^\s*```(?:json)?\s*$", ""), r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(clean), ok(inner))


def number(obj: Column, name: str) -> Column:
    """A numeric member (booleans count as numbers); strings and other kinds are null."""
    v = F.try_variant_get(F.try_parse_json(obj), f"$.{name}", "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|BOOLEAN)"), F.try_variant_get(F.try_parse_json(obj), f"$.{name}", "double"))


def mean_of(*values: Column) -> Column:
    """Mean of the values that aren't null."""
    there = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.size(there))


def gate(t: Column) -> list[Column]:
    """Counter-argument gate: counts, checks, issues."""
    t = F.coalesce(t, F.lit(""))
    n, low = T.n_words(t), F.lower(t)
    signal = F.exists(F.array(*[F.lit(s) for s in dims.COUNTER_SIGNALS]), lambda s: F.contains(low, s))
    ended = t.rlike(r"(?U)[.!?\"']\s*$")
    issues = F.array_compact(
        F.array(
            F.when(~t.rlike(r"(?U)\S"), "empty output"),
            F.when(n < 10, "too short"),
            F.when(~signal, "missing counter-argument signal"),
            F.when(~ended, "possibly truncated"),
        )
    )
    return [n.alias("word_count"), signal.alias("has_counter_signal"), (n >= 10).alias("is_long_enough"), ended.alias("is_not_truncated"), (F.size(issues) == 0).alias("passes_gate"), issues.alias("issues")]


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(cache.select(*key), key, "left_anti")


def score_with_cache(wanted: DataFrame, cache: DataFrame, key: list[str], prompt: str, call: Callable[[list[str]], list[str]], path: str, value: str = "response"):
    """(results, new cache rows). Cached answers are reused; each distinct miss is asked once,
    in batches on the executors, by call(prompts), which gives an answer for each.

    The new rows are written to `path` (a batch of the keyed cache, see AnswerCache) before
    anything is returned, and both frames read what was written: however often they are used,
    the scorer isn't asked again. A task that fails half-way is run again, its batch asked anew.
    Whatever `cache` holds, a wanted row gets one answer: a cache with several rows of a key
    gives its greatest answer.
    """
    todo = cache_misses(wanted.select(*key, prompt).dropDuplicates(key), cache, key)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.select(*key).schema.fields)

    def run(batches):
        for pdf in batches:
            got = call(pdf[prompt].tolist())
            if len(got) != len(pdf):
                raise ValueError(f"{len(got)} answers to {len(pdf)} prompts")
            out = pdf[key].copy()
            out[value] = got
            yield out

    new = AnswerCache(wanted.sparkSession, path, kinds, f"{value} string").add(todo.mapInPandas(run, f"{kinds}, {value} string"))
    known = cache.groupBy(*key).agg(F.max(value).alias(value))
    return wanted.join(known.unionByName(new), key, "left"), new


class AnswerCache:
    """Answers by key, in batches under a folder that any number of jobs may write to.

    A batch is a folder of its own, named by its time, and counts once Spark has marked it as
    complete (_SUCCESS): what a killed writer leaves is never read. read() gives one row a key, the
    answer of the latest batch that has one. compact() writes what is there as one batch, of the
    time of the latest one in it, and deletes the batches it has read; a reader that meets
    both sees the same answers, and later batches still win.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, value: str):
        """key, value: columns as in "output_id string, rubric string"."""
        self.spark, self.path, self.key, self.value = spark, path.rstrip("/"), key, value
        self.keys = [f.name for f in StructType.fromDDL(key).fields]
        self.schema = StructType.fromDDL(f"{key}, {value}")
        self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _sub(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[str]:
        """Complete batches, the earliest first."""
        if not self._fs.exists(self._folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._folder) if s.isDirectory())
        return [n for n in names if n.startswith("batch-") and self._fs.exists(self._sub(f"{n}/_SUCCESS"))]

    def _read(self, names: list[str]) -> DataFrame:
        """key, the value's columns and the batch, as they were written."""
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(""))
        # A batch that is compacted while it is being listed must not fail the reader.
        rows = self.spark.read.schema(self.schema).option("ignoreMissingFiles", True).parquet(*[f"{self.path}/{n}" for n in names])
        return rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/(batch-[^/]+)/[^/]*$", 1))

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        last = F.max(F.struct("_batch", *rest)).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, *[F.col("_last")[c].alias(c) for c in rest])

    def read(self) -> DataFrame:
        """One row a key; no rows where there is no complete batch."""
        return self._latest(self._read(self.batches()))

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes rows as a batch, and gives what was written. Keys are unique in a batch: of
        several rows of a key the greatest answer is kept."""
        name = f"batch-{time.time_ns():020d}-{uuid.uuid4().hex}"
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_v")).select(*self.keys, *[F.col("_v")[c].alias(c) for c in rest])
        one.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def compact(self) -> int:
        """One batch in place of the complete ones there are; their number. Batches that other
        jobs add meanwhile stay. If it is killed, the next one ends its work."""
        names = self.batches()
        if len(names) < 2:
            return len(names)
        to = f"{names[-1]}-all-{uuid.uuid4().hex}"
        self._latest(self._read(names)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{to}")
        for n in names:
            self._fs.delete(self._sub(n), True)
        return len(names)

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Deletes what writers have left incomplete for so many seconds; how many folders."""
        if not self._fs.exists(self._folder):
            return 0
        whole, gone = set(self.batches()), 0
        for s in self._fs.listStatus(self._folder):
            name = s.getPath().getName()
            if s.isDirectory() and name.startswith("batch-") and name not in whole and s.getModificationTime() / 1000 < time.time() - older_than:
                gone += self._fs.delete(s.getPath(), True)
        return gone


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What score_with_cache has written under `path`, one row a key (all columns of the schema
    but the last); empty if there is nothing yet."""
    columns = StructType.fromDDL(schema).fields
    ddl = lambda fields: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return AnswerCache(spark, path, ddl(columns[:-1]), ddl(columns[-1:])).read()


def judge_all(outputs: DataFrame, rubrics: dict[str, str], call: Callable[[list[str]], list[str]], cache_path: str, needs_persona: tuple[str, ...] = ("persona_fidelity",)) -> DataFrame:
    """Outputs with a column a rubric: its answer as a JSON object's text, null where there is
    none in the reply. Rubrics that need a persona are null where there isn't one.

    outputs: output_id and the fields that the templates name (persona, if it is one of
    them, as a description). Answers are cached by output_id and rubric under cache_path.
    """
    spark, wanted = outputs.sparkSession, None
    fields = {c: F.col(c).cast("string") for c in outputs.columns}
    for name, template in rubrics.items():
        rows = outputs.where(F.col("persona").isNotNull()) if name in needs_persona else outputs
        own = rows.select(F.col("output_id").cast("string").alias("output_id"), F.lit(name).alias("rubric"), render(template, **fields).alias("_prompt"))
        wanted = own if wanted is None else wanted.unionByName(own)
    cache = read_cache(spark, cache_path, "output_id string, rubric string, response string")
    scored, _ = score_with_cache(wanted, cache, ["output_id", "rubric"], "_prompt", call, cache_path)
    parsed = scored.groupBy("output_id").pivot("rubric", list(rubrics)).agg(F.first(parse_object(F.col("response"))))
    return outputs.join(parsed.withColumnRenamed("output_id", "_id"), F.col("output_id").cast("string") == F.col("_id"), "left").drop("_id")
