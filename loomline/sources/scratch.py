"""Tables written between the steps of a plan: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where a local session names none is a temporary folder set; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table under the shared folder, reread with the same schema."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/loomline-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files of a folder (or the one file) in the order of their names, by Spark's own file
    systems; names that begin with _ or . aren't data."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where) if s.isFile()]
    return sorted(str(p) for p in found if p.getName().endswith(suffix) and p.getName()[0] not in "_.")
