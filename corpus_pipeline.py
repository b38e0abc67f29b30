"""Corpus pipeline: toxicity, exact dedup, n-gram join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written and
reread as the next stage's `docs`. The stages are in loomline.llm.pipeline.
"""

from loomline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
