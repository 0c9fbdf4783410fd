"""Statistics of data and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import log_histogram
from ..operators.rewrite import num_applicable


def dataset(records: DataFrame) -> DataFrame:
    """One row: records, tokens, average, greatest and distinct numbers."""
    n = F.size("toks")
    own = records.agg(F.count("*").alias("records"), F.sum(n).alias("tokens"), F.avg(n).alias("avg_len"), F.max(n).cast("long").alias("max_len"))
    kinds = records.select(F.explode("toks").alias("t")).agg(F.count_distinct("t").alias("distinct_tokens"))
    both = own.unionByName(kinds, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def metadata(name: str, records: DataFrame, rules: DataFrame) -> dict:
    """Name and sizes of a dataset and its rules, for statistics files."""
    return {"Name": name, "Rules": rules.select("lhs", "rhs").distinct().count(), **dataset(records).first().asDict()}


def characteristics(p: DataFrame) -> DataFrame:
    """(what, least, mean, most, median, p90) of lengths, applicable rules and segmentations of profiled records."""
    d = p.select("id", F.size("toks").cast("double").alias("length"), F.col("transforms").cast("double").alias("transforms")).join(num_applicable(p), "id")
    d = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(n).cast("double").alias("x")) for n in ("length", "rules", "transforms")))).alias("s")).select("s.*")
    return d.groupBy("what").agg(F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("most"), F.percentile("x", 0.5).alias("median"), F.percentile("x", 0.9).alias("p90"))


def token_frequency(records: DataFrame) -> DataFrame:
    return records.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def transforms_distribution(p: DataFrame) -> DataFrame:
    return log_histogram(p, "transforms")


def rule_usage(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(lhs, rhs, places, records) of every rule; found: applicable()."""
    n = found.groupBy("lhs", "rhs").agg(F.count("*").alias("places"), F.count_distinct("id").alias("records"))
    return rules.select("lhs", "rhs").distinct().join(n, ["lhs", "rhs"], "left").fillna(0, ["places", "records"])


def used_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that apply anywhere."""
    return rules.join(found.select("lhs", "rhs").distinct(), ["lhs", "rhs"], "left_semi")
