"""Shared helpers: the shared scratch folder, materialised tables, and table access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ship this subpackage's functions inside the tasks: workers need no install of it.
import loomline.llm as _package

cloudpickle.register_pickle_by_value(_package)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (local runs and tests) a temporary folder is
    set; a local master shares the machine's disk, a cluster must name a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/loomline-{what}-{uuid.uuid4().hex}"


#: Lets Spark delete the files of an execution's shuffles when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives lost executors. What was
    shuffled for it isn't needed any more, and its files are deleted."""
    spark = df.sparkSession
    path, before = scratch(spark, what), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table whose readers are done."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomline-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that very long texts don't make huge ones. The
    bound is the same for all operators, so it doesn't matter which sets it last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def utf8(col) -> object:
    """Text as UTF-8 bytes, null as empty: byte operations then fold A-Z only."""
    return F.coalesce(F.encode(col, "utf-8"), F.lit(b""))


def doc_fold(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo `modulus` (null id: as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def once_a_worker(key: str, make):
    """make(), kept for further tasks of the same Python worker under a key; the last two stay.
    Functions come to a worker anew with each task, so they are kept at a module that stays."""
    import sys

    held = sys.__dict__.setdefault("_loomline_held", {})
    if key not in held:
        while len(held) > 1:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def lean(run):
    """The batch function `run`, returning freed memory to the system when it ends: Python
    workers live on, and the next task's peak would come on top of what this one left."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # no such function outside glibc
            pass

    return wrapped
