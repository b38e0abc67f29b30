"""The filter cascade over a stream of JSON lines: stateless, with counts per batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import cascade


def filtered(spark: SparkSession, path: str, schema: str, rules: Callable[[DataFrame], Sequence[cascade.Rule]]) -> DataFrame:
    rows = spark.readStream.schema(schema).json(path)
    return cascade.with_reason(rows, rules(rows))


def start(rows: DataFrame, kept_path: str, counts_path: str, checkpoint: str):
    """Write each batch's kept rows and its reason counts; rerun batches are replaced."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").json(f"{kept_path}/batch={batch_id}")
        cascade.reason_counts(batch).write.mode("overwrite").json(f"{counts_path}/batch={batch_id}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
