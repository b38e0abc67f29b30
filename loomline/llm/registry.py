"""The llm queries and their DuckDB oracles."""

from __future__ import annotations

from . import collocations, decontaminate, exact_dedup, filter_audit, html_extract, license_scan, lm_score, ngram_join, packing, pipeline, quality, quality_rules, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_quality": quality.op1_quality,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_packing": packing.op6_packing,
        "op7_warc": warc.op7_warc,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_collocations": collocations.op11_collocations,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_quality_rules": quality_rules.op13_quality_rules,
    }


def oracle_sql() -> dict:
    return {
        "op2_ngram_join": ngram_join.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op7_warc": warc.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_collocations": collocations.SQL,
        "op12_filter_audit": filter_audit.SQL,
        "op13_quality_rules": quality_rules.SQL,
    }
