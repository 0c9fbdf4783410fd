"""Positional q-grams of records (PQ), of their rewritings (TPQ), a superset of those without expansion (STPQ), and delta variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rewriting as R
from ..functions.arrays import PAD
from .rewrite import MOST_TRANSFORMS, _rules, expand


def pq(records: DataFrame, q: int, limit: int | None = None) -> DataFrame:
    """(id, pos, gram): a window at every position, padded at the end."""
    padded = F.concat("toks", F.array_repeat(F.lit(PAD), q - 1))
    n = F.size("toks") if limit is None else F.least(F.size("toks"), F.lit(limit))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return records.select("id", F.posexplode(F.transform(at, lambda i: F.slice(padded, i + 1, F.lit(q)))).alias("pos", "gram"))


def pq_ranges(records: DataFrame, q: int) -> DataFrame:
    """(id, low, high, gram) with low = high."""
    return pq(records, q).select("id", F.col("pos").alias("low"), F.col("pos").alias("high"), "gram")


def tpq(m: DataFrame, q: int, most: int = MOST_TRANSFORMS) -> DataFrame:
    """(id, pos, gram) of all rewritings, without repeats."""
    return pq(expand(m, most), q).distinct()


def stpq_ranges(m: DataFrame, q: int, limit: int | None = None) -> DataFrame:
    """(id, low, high, gram): grams of chains of rules, with the positions that the lengths before them allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *g) for i, toks, rules in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for g in R.grams(len(toks), _rules(rules), q, PAD, limit)]
            for lo in range(0, len(rows), 20_000):
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 20_000], strict=True), kinds, strict=True)], ["id", "low", "high", "gram"])

    return m.select("id", "toks", "rules").mapInArrow(run, "id long, low int, high int, gram array<string>")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(id, gram, low, high) with overlapping or touching ranges of a gram as one."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id", "gram").orderBy("low", "high")
    top = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = ranges.withColumn("new", F.when(F.col("low") <= top + 1, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    return d.groupBy("id", "gram", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("k")


def stpq(m: DataFrame, q: int, limit: int | None = None) -> DataFrame:
    """(id, pos, gram) without repeats."""
    return stpq_ranges(m, q, limit).select("id", F.explode(F.sequence("low", "high")).alias("pos"), "gram").distinct()


def gram_counts(grams: DataFrame) -> DataFrame:
    """(pos, gram, n): in how many records a gram stands at a position."""
    return grams.groupBy("pos", "gram").agg(F.count("*").alias("n"))


def variants(grams: DataFrame, q: int, delta: int) -> DataFrame:
    """(id, pos, gram, delta) of (id, pos, gram) of q + delta tokens: q of them; not beginning with a pad, not skipping one."""
    from itertools import combinations

    made = []
    for c in combinations(range(q + delta), q):
        kept = F.array(*(F.get("gram", F.lit(i)) for i in c))
        ok = F.get("gram", F.lit(c[0])) != PAD
        for i in range(c[-1]):
            if i not in c:
                ok &= F.get("gram", F.lit(i)) != PAD
        made.append(F.when(ok, F.struct(kept.alias("gram"), F.lit(c[-1] - q + 1).alias("delta"))))
    v = F.explode(F.array_compact(F.array(*made))).alias("v")
    return grams.select("id", "pos", v).select("id", "pos", "v.gram", "v.delta").distinct()
