"""A corpus through five of the operators: toxicity, near duplicates, repeated passages, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. Toxic documents go; of near duplicates (five-word
shingles, similarity 0.8) one stays; passages of 200 bytes that stand elsewhere are cut out; documents that hold a benchmark
item go; of the rest, the mix takes what the sources' weights give. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontaminate, mixing, near_dedup, suffix_dedup, toxicity
from lexweave.llm.common import read_table, stash, unstash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("source_mix", mix),
]
#: The stages read scores, fingerprints and bytes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        unstash(spark, *before)
        before = [docs]
    return docs
