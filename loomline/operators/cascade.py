"""Filter cascades: ordered reasons, their counts, and limited keeping."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

Rule = tuple[str, Column]


def with_reason(df: DataFrame, rules: Sequence[Rule], out: str = "reason") -> DataFrame:
    """The first rule that holds names the reason; null means kept."""
    case = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        case = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(case)
    return df.withColumn(out, case)


def _length(name: str, t: Column, low: int, high: int) -> list[Rule]:
    return [(f"{name}_too_short", T.n_words(t) < low), (f"{name}_too_long", T.n_words(t) > high)]


def reply_rules(reply: Column) -> list[Rule]:
    return [
        ("empty_response", T.is_empty(reply)),
        ("deleted_marker", T.has_deleted_marker(reply)),
        *_length("response", reply, 30, 250),
        ("mostly_links", T.link_ratio(reply) > 0.4),
    ]


def claim_holds(claim: Column) -> Column:
    """Claims outside this are dropped without a count."""
    return ~T.is_empty(claim) & ~T.has_deleted_marker(claim) & T.n_words(claim).between(20, 300)


def answer_rules(question: Column, answer: Column) -> list[Rule]:
    return [
        ("empty_input", T.is_empty(question)),
        ("empty_response", T.is_empty(answer)),
        *_length("question", question, 20, 500),
        *_length("answer", answer, 40, 300),
        ("mostly_code", T.code_ratio(answer) > 0.4),
        ("mostly_links", T.link_ratio(answer) > 0.4),
    ]


def abstract_rules(title: Column, abstract: Column) -> list[Rule]:
    return [
        ("empty_input", T.is_empty(title)),
        ("empty_response", T.is_empty(abstract)),
        *_length("title", title, 4, 40),
        *_length("abstract", abstract, 80, 250),
        ("formula_heavy", T.formula_ratio(abstract) > 0.12),
    ]


def argument_rules(topic: Column, argument: Column, wa: Column) -> list[Rule]:
    return [
        ("empty_input", T.is_empty(topic)),
        ("empty_response", T.is_empty(argument)),
        *_length("topic", topic, 3, 40),
        *_length("argument", argument, 8, 60),
        ("low_quality", F.coalesce(wa < 0.65, F.lit(False))),
    ]


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows by reason; kept rows count as 'kept'."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: total_seen, total_kept, total_filtered, and the counts of reasons that occur."""
    per = reason_counts(df, reason).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("_m"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_seen"))
    kept = F.coalesce(F.try_element_at("_m", F.lit("kept")), F.lit(0))
    return per.select("total_seen", kept.alias("total_kept"), (F.col("total_seen") - kept).alias("total_filtered"), F.map_filter("_m", lambda k, _: k != "kept").alias("filter_counts"))


def keep_limited(df: DataFrame, order: str, limit: int, reason: str = "reason", bucket_rows: int = 4096) -> DataFrame:
    """Rows up to and with the limit-th kept one, in the order of an integer column.

    The prefix count has two levels, by ranges of the order column and inside a range, so
    no task sees all rows.
    """
    kept = F.when(F.col(reason).isNull(), 1).otherwise(0)
    rows = df.withColumn("_k", kept).withColumn("_b", F.floor(F.col(order) / bucket_rows))
    per = rows.groupBy("_b").agg(F.sum("_k").alias("_c"))
    before = per.select("_b", (F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("_before") + F.sum("_k").over(inside) - F.col("_k")
    return rows.join(before, "_b").withColumn("_seen", seen).where(F.col("_seen") < limit).drop("_k", "_b", "_before", "_seen")


def keep_first(spark: SparkSession, files: Sequence[str], read: Callable[[list[str]], DataFrame], rules: Sequence[Rule], limit: int) -> tuple[DataFrame, dict]:
    """(rows up to and with the limit-th kept one, what was read), in the order of `files` and of
    the rows in them, without reading files that this doesn't need.

    read(paths) gives the rows of some files with their _metadata (any of Spark's file sources).
    Files are read in runs: the first, then as many as the share of kept rows so far asks for, at
    most as many as were read before. Each is read once to count, and those that count once more
    by whoever uses the result. The report has files, files_read, runs and kept. Rows carry
    `reason` (null: kept). limit 0, no files, or files without rows give no rows.
    """
    if limit < 0:
        raise ValueError("limit must be 0 or more")
    files, taken, kept, runs, parts = list(files), 0, 0, 0, []
    while kept < limit and taken < len(files):
        guess = taken if not kept else min(taken, math.ceil((limit - kept) * taken / kept))
        some = files[taken : taken + max(1, guess)]
        found = _placed(read(some), some, taken, rules).groupBy("_file", "_start").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("n")).collect()  # a row a split
        parts += [(r["_file"], r["_start"], r["n"]) for r in found]
        taken, kept, runs = taken + len(some), kept + sum(r["n"] for r in found), runs + 1
    report = {"files": len(files), "files_read": taken, "runs": runs, "kept": min(kept, limit)}
    if not files:
        return spark.createDataFrame([], "reason string"), report
    use = files[: max(1, taken)]
    rows = _placed(read(use), use, 0, rules)
    before, at = [], 0
    for f, start, n in sorted(parts):
        before.append((f, start, at))
        at += n
    before = spark.createDataFrame(before, "_file int, _start long, _before long")
    own = Window.partitionBy("_file", "_start").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)  # of one split
    seen = F.col("_before") + F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(own) - F.when(F.col("reason").isNull(), 1).otherwise(0)
    needed = rows.join(F.broadcast(before.where(F.col("_before") < limit)), ["_file", "_start"])  # a row a split of the files read
    return needed.withColumn("_seen", seen).where(F.col("_seen") < limit).drop("_file", "_start", "_row", "_before", "_seen"), report


def _placed(rows: DataFrame, files: list[str], first: int, rules: Sequence[Rule]) -> DataFrame:
    """Rows with their reason, the number of their file, their split's start and their place in it."""
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")
    numbers = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit("/" + re.sub("^[a-z]+:/+", "", f).lstrip("/")), F.lit(first + i))])
    known = rows.select("*", numbers[path].alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return with_reason(known, rules)
