"""Text sources: records (a line each), rules (`lhs, rhs`) and pairs (two whole numbers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = "[ \\t]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between runs of blanks and tabs; trailing blanks make none, an empty line is one empty token."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t]+$", ""), BLANKS)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, raw) with the 0-based number of the line.

    Numbers are those of one file in its order: each partition's lines are counted first, and every line gets its partition's start and its
    place there. What reaches the driver is a number a partition.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    part = F.shiftright("at", 33)
    n = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(n):
        starts.append((p, total - (p << 33)))
        total += n[p]
    shift = spark.createDataFrame(starts, "p long, shift long")
    return rows.withColumn("p", part).join(F.broadcast(shift), "p").select((F.col("at") + F.col("shift")).alias("id"), "raw")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return with_tokens(lines(spark, path))


def with_tokens(rows: DataFrame, text: str = "raw", key: str = "id") -> DataFrame:
    """(id, raw, toks) of a table that has a key of its own."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("raw"), tokens(F.col(text)).alias("toks"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, lhs, rhs); fields after the second are ignored."""
    parts = F.split("raw", ", ")
    side = lambda i: F.split(F.trim(F.lower(parts[i])), " ")
    return lines(spark, path).filter(F.size(parts) > 1).select(F.col("id").alias("rule_id"), side(0).alias("lhs"), side(1).alias("rhs"))


def rules_of(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rules given in the program."""
    rows = [(i, a.split(" "), b.split(" ")) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "rule_id long, lhs array<string>, rhs array<string>")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id1, id2) of a ground-truth file."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).select(p[0].cast("long").alias("id1"), p[1].cast("long").alias("id2")).filter("id2 IS NOT NULL")
