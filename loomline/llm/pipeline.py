"""Corpus pipeline: clean a corpus and pack it for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written and
reread as the next stage's `docs`. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, ngram_join, packing, toxicity
from .common import discard, fresh, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of `docs`, doesn't reject.

    Null and empty texts are scored like any other; without labels of both kinds the score is
    a constant below 1/2 unless most labels are toxic. Repeated rows get equal scores; null
    and repeated ids stay; an empty table gives no rows; other columns pass unchanged.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=None)
    score = fresh(docs, "_toxicity")
    scored = toxicity.toxicity(docs, model, out_col=score)
    return scored.where(F.col(score) < 0.5).select(*[F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of the least id.

    Null counts as the empty text; a null id loses to any other; of rows tied on id and text
    one stays. An empty table gives no rows; other columns pass unchanged.
    """
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 or more.

    The one of the least id stays. Texts without words link with nothing and all stay; a null
    id is the last choice. An empty table gives no rows; other columns pass unchanged.
    """
    return ngram_join.survivors(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item (or a whole shorter item).

    Null and empty texts hit nothing and stay, and so do all documents if the benchmark is
    empty. An empty table gives no rows; other columns pass unchanged.
    """
    hits = fresh(docs, "_hits")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), out_col=hits)
    return found.where(F.col(hits)["n_hit"] == 0).select(*[F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets of least padding, in batches of a token budget.

    One row a sequence; a null or empty text is one sequence of its end. Repeated rows are
    packed each by itself; an empty table gives no rows; only doc_id and text are read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a hash-dealt packing aren't expressible in SQL; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows; what a stage has written goes when the next has read it."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
            if written is not None:
                discard(written)
            written = docs
    return docs
