"""Sampled cost model of the hybrid strategies. It chooses a plan only; every plan gives the same pairs.

Searched records of few segmentations are expanded, the others go to grams. The threshold is the number of segmentations at which the
estimated cost is least: what expansion costs up to it, plus what grams cost above it. Costs are rows that the two plans would make
on a seeded sample: expansions for the one, grams and the pairs they meet for the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins, qgrams
from ..operators.rewrite import MOST_TRANSFORMS

#: Records of more segmentations than this are never expanded by a hybrid.
MOST_EXPANDED = 100_000
LEAST_SAMPLE = 10


@dataclass(frozen=True)
class Plan:
    threshold: int
    index: str  # "first" or "best"


def sample_fraction(ratio: float, n: int) -> float:
    """A ratio above 1 is a number of records; at least LEAST_SAMPLE records are taken."""
    if n == 0:
        return 1.0
    return min(1.0, max(ratio if ratio <= 1 else ratio / n, LEAST_SAMPLE / n))


def bernoulli(s: DataFrame, ratio: float, seed: int, most: int = MOST_TRANSFORMS) -> DataFrame:
    """A seeded sample of the searchable records, by a digest of their ids so that it does not depend on partitions."""
    s = s.filter(F.col("transforms") <= most)
    part = sample_fraction(ratio, s.count())
    return s.filter(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000))


def stratified(s: DataFrame, ratio: float, seed: int, strata: int = 20) -> DataFrame:
    """As many of each stratum of equally many records, by segmentations; one of each at least.

    Quantiles bound the strata, so that no task orders all records.
    """
    cuts = s.approxQuantile("transforms", [i / strata for i in range(1, strata)], 0.001) if s.take(1) else []
    stratum = sum((F.when(F.col("transforms") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return _of_each(s.withColumn("stratum", stratum), ratio, seed)


def stratified_log(s: DataFrame, ratio: float, seed: int) -> DataFrame:
    return _of_each(s.withColumn("stratum", F.floor(F.log10(F.greatest(F.col("transforms"), F.lit(1))))), ratio, seed)


def _of_each(s: DataFrame, ratio: float, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000))
    first = s.groupBy("stratum").agg(F.min(F.struct(u.alias("u"), "id")).alias("f")).select("stratum", F.col("f.id").alias("first_id"))
    return s.join(F.broadcast(first), "stratum").filter((u < int(ratio * 1_000_000)) | (F.col("id") == F.col("first_id"))).drop("stratum", "first_id")


def costs(s: DataFrame, t: DataFrame, q: int, k: int, ratio: float, seed: int, delta: int = 0) -> DataFrame:
    """(transforms, expand, first, best): summed costs of the sampled records, a row for each number of segmentations."""
    part = bernoulli(s, ratio, seed).select("id", "toks", "rules", "min_len", "max_len", "transforms")
    size = q + delta
    probe = qgrams.stpq(part, size)
    index = qgrams.pq(t, size)
    counts = qgrams.gram_counts(index)
    met = probe.join(counts, ["pos", "gram"], "left").groupBy("id").agg(
        F.count("*").alias("grams"), F.sum(F.when(F.col("pos") < k, F.coalesce("n", F.lit(0))).otherwise(0)).alias("met_first"), F.min(F.coalesce("n", F.lit(0))).alias("met_best")
    )
    d = part.join(met, "id", "left").select("transforms", (F.col("transforms") * F.col("max_len")).cast("double").alias("expand"), (F.coalesce("grams", F.lit(0)) + F.coalesce("met_first", F.lit(0))).cast("double").alias("first"), (2 * F.coalesce("grams", F.lit(0)) + k * F.coalesce("met_best", F.lit(0))).cast("double").alias("best"))
    return d.groupBy("transforms").agg(*(F.sum(c).alias(c) for c in ("expand", "first", "best")))


def thresholds(cost: DataFrame) -> DataFrame:
    """(threshold, index, cost): expansion up to the threshold, grams above it; 0 expands nothing."""
    upto = W.orderBy("transforms")
    every = W.partitionBy()
    at = cost.withColumn("below", F.sum("expand").over(upto))
    out = None
    for name in ("first", "best"):
        d = at.select(F.col("transforms").alias("threshold"), F.lit(name).alias("index"), (F.col("below") + F.sum(name).over(every) - F.sum(name).over(upto)).alias("cost"))
        d = d.unionByName(cost.agg(F.sum(name).alias("cost")).select(F.lit(0).cast("long").alias("threshold"), F.lit(name).alias("index"), "cost"))
        out = d if out is None else out.unionByName(d)
    return out.filter(F.col("threshold") <= MOST_EXPANDED)


def choose(s: DataFrame, t: DataFrame, q: int, k: int, ratio: float, seed: int, delta: int = 0) -> Plan:
    best = thresholds(costs(s, t, q, k, ratio, seed, delta)).orderBy("cost", "threshold", "index").first()
    return Plan(int(best["threshold"]), best["index"]) if best and best["cost"] is not None else Plan(0, "first")


def hybrid(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2, sample: float | None = None, sample_plan: float = 0.05, seed: int = 7, most: int = MOST_TRANSFORMS, plan: Plan | None = None, **more) -> DataFrame:
    plan = plan or choose(s, t, q, k, sample_plan, seed)
    few, many = s.filter(F.col("transforms") <= plan.threshold), s.filter(F.col("transforms") > plan.threshold)
    grams = joins.first_k(many, t, k=k, q=q, most=most) if plan.index == "first" else joins.best_k(many, t, k=k, q=q, sample=sample, seed=seed, most=most)
    return joins.naive(few, t, most).unionByName(grams).distinct()


def delta_hybrid(s: DataFrame, t: DataFrame, delta: int = 1, dist: str = "edit", sample: float | None = None, sample_plan: float = 0.05, seed: int = 7, most: int = MOST_TRANSFORMS, plan: Plan | None = None, **more) -> DataFrame:
    """Below the threshold deletions, above it variants: the first 3 positions of 4-grams, or the best 2 of 2-grams."""
    plan = plan or choose(s, t, 2, 2, sample_plan, seed, delta)
    few, many = s.filter(F.col("transforms") <= plan.threshold), s.filter(F.col("transforms") > plan.threshold)
    grams = joins.delta_var(many, t, 3, 4, delta, dist, most=most) if plan.index == "first" else joins.delta_var(many, t, 2, 2, delta, dist, True, sample, seed, most=most)
    return joins.delta_naive(few, t, delta, dist, most).unionByName(grams).distinct()
