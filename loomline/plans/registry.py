"""Where queries and their DuckDB oracles register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: CTEs that end in reps(doc_id, reps): words repeated four times or more in a row, by document.
REPS = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS s, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM documents),
w AS (SELECT doc_id, i, lower(s) AS s, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS gap, lag(lower(s), 2) OVER (PARTITION BY doc_id ORDER BY i) AS old, lead(lower(s), 2) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS gap2 FROM p),
v AS (SELECT * FROM w WHERE regexp_matches(s, '^[\p{L}\p{N}_]')),
r AS (SELECT *, sum(CASE WHEN gap = ' ' AND s = old THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM v),
g AS (SELECT doc_id, run, count(*) AS n, max(s) AS s, arg_max(CASE WHEN gap2 = ' ' THEN nxt END, i) AS nxt FROM r GROUP BY 1, 2),
reps AS (SELECT doc_id, count(*) AS reps FROM g WHERE n >= 4 OR n = 3 AND starts_with(nxt, s) GROUP BY 1)"""


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
