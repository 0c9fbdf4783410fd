"""The queries of this package, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, language_id, license_scan, lm_score, media, mixing, suffix_dedup, token_counts, toxicity
from .common import read_table
from .oracles import oracle_sql


__all__ = ["oracle_sql", "queries"]


def _over_documents(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(read_table(spark, sf_dir, "documents"))

    return run


def queries() -> dict:
    return {
        "op1_license_scan": _over_documents(license_scan.query),
        "op2_jaccard_join": _over_documents(jaccard_join.query),
        "op3_mix_sources": _over_documents(mixing.query),
        "op4_toxicity": lambda spark, sf_dir: toxicity.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
        "op5_lm_score": _over_documents(lm_score.query),
        "op6_token_counts": _over_documents(token_counts.query),
        "op7_suffix_dedup": _over_documents(suffix_dedup.query),
        "op8_media_columns": _over_documents(media.query),
        "op9_decontaminate": lambda spark, sf_dir: decontaminate.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
        "op10_language_id": _over_documents(language_id.query),
    }
