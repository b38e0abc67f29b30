import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ties, clashing names."""
    long = "word another thing " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \t\n ", "en", "a", 5), (4, "one", "en", "a", 3), (5, "one two three four five six seven", "en", None, 9)]
    rows += [(5, "one two three four five six seven", "en", None, 9), (None, "one two three four five six seven", None, "b", 1), (7, long, "fr", "b", 2), (8, long + "end", "fr", "b", 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_id", "_t", "_key", "_n", "hits_", "_len", "score_", "_h"):
        df = df.withColumn(name, df["n_chars"])
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
