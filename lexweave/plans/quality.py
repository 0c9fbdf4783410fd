"""Quality of a result against the truth, and the power of the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, qgrams
from ..operators.verify import verify


def _pairs(d: DataFrame) -> DataFrame:
    return d.select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2")).distinct()


def confusion(found: DataFrame, truth: DataFrame, searched: DataFrame | None = None, indexed: DataFrame | None = None, self_join: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True positives, false negatives, false positives. Pairs of one id (self join) and pairs that really are rewritings are not false."""
    found, truth = _pairs(found), _pairs(truth)
    tp, fn, fp = found.join(truth, ["id1", "id2"]), truth.join(found, ["id1", "id2"], "left_anti"), found.join(truth, ["id1", "id2"], "left_anti")
    if self_join:
        fp = fp.filter("id1 <> id2")
    if searched is not None:
        fp = fp.join(verify(fp, searched, indexed, "sequence"), ["id1", "id2"], "left_anti")
        if self_join:
            flip = fp.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
            ok = verify(flip, searched, indexed, "sequence").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
            fp = fp.join(ok, ["id1", "id2"], "left_anti")
    return tp, fn, fp


def scores(tp: DataFrame, fn: DataFrame, fp: DataFrame) -> DataFrame:
    """One row: tp, fn, fp, precision, recall, f1."""
    n = None
    for name, d in (("tp", tp), ("fn", fn), ("fp", fp)):
        c = d.select(F.lit(name).alias("k"))
        n = c if n is None else n.unionByName(c)
    count = lambda k: F.count(F.when(F.col("k") == k, 1)).alias(k)
    d = n.agg(count("tp"), count("fn"), count("fp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    d = d.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def filter_power(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2) -> DataFrame:
    """(filters, candidates) of the best-k strategy with its filters on and off."""
    from ..operators import orders

    out = None
    for use_stpq in (True, False):
        probe = joins._stpq(s, q, use_stpq, None, joins.MOST_TRANSFORMS)
        index = orders.best_positions(qgrams.pq(t, q), qgrams.gram_counts(probe), k).select("id", "pos", "gram")
        for use_lf in (True, False):
            name = f"{'STPQ' if use_stpq else 'TPQ'}{'+LF' if use_lf else ''}"
            d = joins._gram_candidates(s, t, probe, index, use_lf).agg(F.count("*").alias("candidates")).select(F.lit(name).alias("filters"), "candidates")
            out = d if out is None else out.unionByName(d)
    d = joins.pairs_by_length(s, t).agg(F.count("*").alias("candidates")).select(F.lit("LF").alias("filters"), "candidates")
    return out.unionByName(d)


def gram_superset(m: DataFrame, q: int) -> DataFrame:
    """One row: positional grams of the rewritings, of the superset, and those of the superset that no rewriting has."""
    exact, wide = qgrams.tpq(m, q), qgrams.stpq(m, q)
    false = wide.join(exact, ["id", "pos", "gram"], "left_anti")
    counts = None
    for d, n in ((exact, "tpq"), (wide, "stpq"), (false, "false_grams")):
        c = d.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return counts.agg(*(F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in ("tpq", "stpq", "false_grams")))
