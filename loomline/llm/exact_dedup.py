"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned on a bounded sort key of their normalised bytes (a 16-character
prefix, then a hash; Spark samples the splitters), each partition is sorted externally by
key and then whole text, and adjacent rows are compared on the whole text. Texts that
occur in very many rows get a salt in the key, so their run is cut into sub-runs over
several partitions; one row per sub-run is then merged by whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: At most this many texts are treated as hot, whatever the input's size.
MAX_HOT = 10_000


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    carry: Sequence[str] = (),
    hot_rows: int = 1_000,
) -> DataFrame:
    """Group equal texts and choose the row of each group that stays.

    Returns one row per input row: id_col, keep_id (id of the row that stays), group_size
    (rows of the group), kept, text_sha256 (of the normalised UTF-8 text), and a struct
    `row` of the columns in `carry`, if any.

    keep: "min" or "max" id stays. normalise: text column to text column; none by default.
    hot_rows: runs over this many rows (and over a 1/10000 of the input) are salted.

    Null text counts as empty, and empty texts form a group of their own. A null id loses
    to any other; a group of null ids has keep_id null. Of rows tied on id and text one is
    kept. An empty table gives no rows. Other columns, whatever their names, are ignored
    unless carried.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    spark = docs.sparkSession
    text = F.col(text_col)
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    src = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_t"),
        *([F.struct(*[F.col(c) for c in carry]).alias("_row")] if carry else []),
    ).withColumn("_h", F.xxhash64("_t"))

    # Hot texts: partial counts collapse copies before the shuffle; at most MAX_HOT remain.
    least = max(hot_rows, docs.count() // MAX_HOT)
    hot = [
        (r["_h"], -(-r["n"] // least))
        for r in src.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
    ]
    if hot:
        salts = spark.createDataFrame(hot, "_h long, _k int")
        src = src.join(F.broadcast(salts), "_h", "left").withColumn(
            "_salt", F.when(F.col("_k").isNull(), -1).otherwise(F.pmod(F.xxhash64("_id"), F.col("_k")).cast("int"))
        )
    # A constant salt would be folded out of the window's keys but not out of the
    # partitioning, and the window would then shuffle again: so no salt without hot texts.
    key = ["_p", "_h", *(["_salt"] if hot else [])]
    ranged = src.withColumn("_p", F.substring("_t", 1, 16)).repartitionByRange(*key)
    run = Window.partitionBy(*key, "_t")
    order = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    ordered = run.orderBy(order)
    rows = ranged.select(
        "_id",
        F.row_number().over(ordered).alias("_rn"),
        F.first("_id").over(ordered).alias("_best"),
        F.count(F.lit(1)).over(run).alias("_n"),
        F.sha2(F.col("_t"), 256).alias("_sha"),
        (F.col("_salt") >= 0 if hot else F.lit(False)).alias("_hot"),
        "_t",
        *(["_row"] if carry else []),
    ).withColumn("_head", F.when(F.col("_hot") & (F.col("_rn") == 1), F.col("_t")))
    rows = materialise(rows.drop("_t"), "content-sort")

    best, size = F.col("_best"), F.col("_n")
    if hot:  # merge the sub-runs of the hot texts on their whole text: few rows
        pick = F.min if keep == "min" else F.max
        merged = (
            rows.where("_hot and _rn = 1")
            .groupBy("_head")
            .agg(F.first("_sha").alias("_sha"), pick("_best").alias("_all"), F.sum("_n").alias("_size"))
            .select("_sha", "_all", "_size", F.lit(True).alias("_m"))
        )
        rows = rows.join(F.broadcast(merged), "_sha", "left")  # at most MAX_HOT narrow rows
        best = F.when(F.col("_m"), F.col("_all")).otherwise(best)
        size = F.coalesce(F.col("_size"), size)
    return rows.select(
        F.col("_id").alias(id_col),
        best.alias("keep_id"),
        size.cast("long").alias("group_size"),
        ((F.col("_rn") == 1) & F.col("_id").eqNullSafe(best)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_row").alias("row")] if carry else []),
    )


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`. Options as content_sort."""
    return content_sort(docs, carry=docs.columns, **options).where("kept").select("row.*")


def op4_exact_dedup(spark, sf_dir):
    """Groups of equal texts of `documents`; edge cases as content_sort() says."""
    return content_sort(table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
