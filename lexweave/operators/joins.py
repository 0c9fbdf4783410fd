"""Join strategies. Each takes the matched, profiled searched side s, the indexed records t and parameters, and returns (id1, id2).

All strategies of a class give the same pairs: sequence (t is a rewriting of s), set (equal as sets), delta (within a distance)
and the two Jaccard classes. Candidates always come from an equi-join on a gram, signature, segment, variant or length,
with the length filter in the join's condition, and are made distinct before they are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rewriting as R
from ..functions.arrays import token_set
from . import orders, qgrams
from .rewrite import MOST_TRANSFORMS, expand, full_set, num_transforms
from .verify import verify


def _length(delta: int = 0) -> Column:
    """The indexed length lies in the range of the searched record's rewritings."""
    return (F.col("min_len") - delta <= F.col("t_len")) & (F.col("t_len") <= F.col("max_len") + delta)


def _probe(s: DataFrame, grams: DataFrame, *more: str) -> DataFrame:
    """Grams with their record's lengths."""
    return grams.join(s.select("id", "min_len", "max_len"), "id").select(F.col("id").alias("id1"), "min_len", "max_len", "pos", "gram", *more)


def _index(t: DataFrame, grams: DataFrame, *more: str) -> DataFrame:
    """Grams with their record's length and their number."""
    n = grams.groupBy("id").agg(F.count_distinct("pos").alias("indexed"))
    return grams.join(t.select("id", F.size("toks").alias("t_len")), "id").join(n, "id").select(F.col("id").alias("id2"), "t_len", "indexed", "pos", "gram", *more)


def pairs_by_length(s: DataFrame, t: DataFrame, delta: int = 0, most_len: int | None = None) -> DataFrame:
    """All pairs that pass the length filter: an equi-join on the lengths a record can take."""
    low, high = F.greatest(F.lit(0), F.col("min_len") - delta), F.col("max_len") + delta
    if most_len is not None:
        s = s.filter(low <= most_len)
        high = F.least(high, F.lit(most_len))
    a = s.select(F.col("id").alias("id1"), F.explode(F.sequence(low, high)).alias("t_len"))
    return a.join(t.select(F.col("id").alias("id2"), F.size("toks").alias("t_len")), "t_len").select("id1", "id2")


# sequence class


def naive(s: DataFrame, t: DataFrame, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Records of more than `most` segmentations are not expanded but found by grams, as in all strategies that expand."""
    made = expand(s, most).select(F.col("id").alias("id1"), "toks")
    found = made.join(t.select(F.col("id").alias("id2"), "toks"), "toks").select("id1", "id2").distinct()
    return _and_large(found, s, most, lambda large: first_k(large, t))


def _and_large(found: DataFrame, s: DataFrame, most: int, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What expansion found, and the pairs of records that are too large to expand, by a plan without expansion."""
    large = s.filter(num_transforms() > most)
    return found.unionByName(plan(large)).distinct() if large.take(1) else found


def _gram_candidates(s: DataFrame, t: DataFrame, probe: DataFrame, indexed: DataFrame, use_lf: bool) -> DataFrame:
    a, b = _probe(s, probe), _index(t, indexed)
    hit = a.join(b, ["pos", "gram"])
    if use_lf:
        hit = hit.filter(_length())
    count = hit.groupBy("id1", "id2").agg(F.count_distinct("pos").alias("hits"), F.first("indexed").alias("indexed"))
    return count.filter("hits >= indexed").select("id1", "id2")


def _stpq(s: DataFrame, q: int, use_stpq: bool, limit: int | None, most: int) -> DataFrame:
    if use_stpq:
        return qgrams.stpq(s, q, limit)
    grams = qgrams.tpq(s, q, most)
    large = s.filter(num_transforms() > most)
    if large.take(1):
        grams = grams.unionByName(qgrams.stpq(large, q))
    return grams if limit is None else grams.filter(F.col("pos") < limit)


def first_k(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2, use_lf: bool = True, use_pqf: bool = True, use_stpq: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Grams of the first k positions."""
    if not use_pqf:
        return verify(pairs_by_length(s, t), s, t, "sequence")
    found = _gram_candidates(s, t, _stpq(s, q, use_stpq, k, most), qgrams.pq(t, q, k), use_lf)
    return verify(found, s, t, "sequence")


def best_k(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2, use_lf: bool = True, use_pqf: bool = True, use_stpq: bool = True, sample: float | None = None, seed: int = 7, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Grams of the k positions at which the searched side has them least; sample: count on a part of the searched side."""
    if not use_pqf:
        return verify(pairs_by_length(s, t), s, t, "sequence")
    probe = _stpq(s, q, use_stpq, None, most)
    counted = probe if sample is None else _stpq(s.sample(sample, seed), q, use_stpq, None, most)
    indexed = orders.best_positions(qgrams.pq(t, q), qgrams.gram_counts(counted), k)
    return verify(_gram_candidates(s, t, probe, indexed.select("id", "pos", "gram"), use_lf), s, t, "sequence")


def best_k_fast(s: DataFrame, t: DataFrame, sample: float = 0.01, **more) -> DataFrame:
    return best_k(s, t, sample=sample, **more)


def prefix_signatures(s: DataFrame, counts: DataFrame, size: int = 1, most: int = MOST_TRANSFORMS) -> DataFrame:
    """(id1, token): the tokens that are among the `size` rarest of some rewriting. Ranks come with each record's own tokens."""
    used = s.select("id", F.explode(F.array_distinct(F.flatten(F.transform("rules", lambda r: r["rhs"])))).alias("token"))
    keys = used.join(counts, "token", "left").groupBy("id").agg(F.collect_list(F.struct(orders.frequency_key(F.col("n"), F.col("token")).alias("key"), "token")).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, toks, rules, known in zip(*(b.column(c).to_pylist() for c in ("id", "toks", "rules", "keys")), strict=True):
                order = [x["token"] for x in sorted(known, key=lambda x: x["key"])]
                rank = {t: k for k, t in enumerate(order)}.__getitem__
                own = [(r["start"], r["n"], tuple(r["rhs"])) for r in rules]
                got = [order[k] for k in sorted(R.least_tokens(len(toks), own, rank)) if k < len(order)] if size == 1 else [t for t in order if R.in_prefix(len(toks), own, rank, t, size)]
                ids += [i] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id1", "token"])

    return s.join(keys, "id").select("id", "toks", "rules", "keys").mapInArrow(run, "id1 long, token string")


def least_token_signatures(s: DataFrame, counts: DataFrame, most: int = MOST_TRANSFORMS) -> DataFrame:
    return prefix_signatures(s, counts, 1, most)


def signature(s: DataFrame, t: DataFrame, check: str = "sequence", set_filter: bool = False, use_lf: bool = True, most: int = MOST_TRANSFORMS, **parameters) -> DataFrame:
    """The rarest token of t is the rarest of some rewriting of s."""
    counts = orders.rhs_counts(s)
    a = least_token_signatures(s, counts, most).join(s.select(F.col("id").alias("id1"), "min_len", "max_len"), "id1")
    b = orders.rarest(t, counts, 1).join(t.select("id", F.size("toks").alias("t_len")), "id").select(F.col("id").alias("id2"), "token", "t_len", "n_set")
    ok = F.lit(True) if not use_lf else (F.col("max_len") >= F.col("n_set")) if set_filter else _length()
    return verify(a.join(b, "token").filter(ok).select("id1", "id2").distinct(), s, t, check, **parameters)


def si_tree(s: DataFrame, t: DataFrame, **more) -> DataFrame:
    return signature(s, t, "sequence", **more)


def si_candidates(s: DataFrame, t: DataFrame, most: int = MOST_TRANSFORMS) -> DataFrame:
    """Pairs that share a signature and pass the length fences, not verified."""
    counts = orders.rhs_counts(s)
    a = least_token_signatures(s, counts, most).join(s.select(F.col("id").alias("id1"), "min_len", "max_len"), "id1")
    b = orders.rarest(t, counts, 1).join(t.select("id", F.size("toks").alias("t_len")), "id").select(F.col("id").alias("id2"), "token", "t_len")
    return a.join(b, "token").filter(_length()).select("id1", "id2").distinct()


VERIFY = {"naive": "sequence_naive", "greedy": "sequence_greedy", "DP": "sequence"}
SET_VERIFY = {"naive": "set_naive", "greedy": "set_greedy", "DP": "set", "MIT_GR": "set_greedy", "beam": "set_beam"}


def pkduck(s: DataFrame, t: DataFrame, order: str = "FF", check: str = "DP", rc: bool = False, use_lf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """order FF: signature by frequency; PF: by position, so the first token. rc (rule compression) gives the same pairs."""
    if order == "FF":
        return signature(s, t, VERIFY[check], use_lf=use_lf, most=most)
    a = qgrams.stpq(s, 1, 1).join(s.select("id", "min_len", "max_len"), "id").select(F.col("id").alias("id1"), "gram", "min_len", "max_len")
    b = t.select(F.col("id").alias("id2"), F.slice("toks", 1, 1).alias("gram"), F.size("toks").alias("t_len"))
    hit = a.join(b, "gram")
    return verify((hit.filter(_length()) if use_lf else hit).select("id1", "id2").distinct(), s, t, VERIFY[check])


# set class


def set_naive(s: DataFrame, t: DataFrame, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    a = expand(s, most).select(F.col("id").alias("id1"), token_set(F.col("toks")).alias("k")).distinct()
    found = a.join(t.select(F.col("id").alias("id2"), token_set(F.col("toks")).alias("k")), "k").select("id1", "id2").distinct()
    return _and_large(found, s, most, lambda large: pkduck_set(large, t))


def pkduck_set(s: DataFrame, t: DataFrame, check: str = "DP", rc: bool = False, use_lf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    return signature(s, t, SET_VERIFY[check], set_filter=True, use_lf=use_lf, most=most)


def _rhs_tokens(s: DataFrame) -> DataFrame:
    return s.select(F.col("id").alias("id1"), "max_len", F.explode(F.array_distinct(F.flatten(F.transform("rules", lambda r: r["rhs"])))).alias("token"))


def best_k_set(s: DataFrame, t: DataFrame, k: int = 1, check: str = "DP", beam: int = 2, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """All of the k rarest tokens of t are available to s."""
    b = orders.rarest(t, orders.rhs_counts(s), k).select(F.col("id").alias("id2"), "token", "n_set", F.least(F.lit(k), F.col("n_set")).alias("indexed"))
    hit = _rhs_tokens(s).join(b, "token").filter("max_len >= n_set")
    found = hit.groupBy("id1", "id2").agg(F.count("*").alias("hits"), F.first("indexed").alias("indexed")).filter("hits >= indexed").select("id1", "id2")
    return verify(found, s, t, SET_VERIFY[check], beam=beam)


# delta class


def _short(s: DataFrame, t: DataFrame, delta: int, most_len: int, most: int) -> DataFrame:
    """Pairs of lengths at which grams prove nothing."""
    return pairs_by_length(s, t.filter(F.size("toks") <= most_len), delta, most_len)


def all_pairs(s: DataFrame, t: DataFrame, delta: int = 0, dist: str = "edit", most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    return verify(pairs_by_length(s, t, delta), s, t, "delta", delta=delta, dist=dist)


def _deletions(rows: DataFrame, key: str, delta: int) -> DataFrame:
    """(key, toks, lost): every subsequence that lacks `delta` tokens at most."""
    d = rows.select(key, "toks", F.lit(0).alias("lost"))
    out = d
    for k in range(1, delta + 1):
        at = F.when(F.size("toks") > 0, F.sequence(F.lit(0), F.size("toks") - 1)).otherwise(F.array().cast("array<int>"))
        d = d.select(key, F.explode(F.transform(at, lambda i: F.filter("toks", lambda _, j: j != i))).alias("toks"), F.lit(k).alias("lost")).distinct()
        out = out.unionByName(d)
    return out


def delta_naive(s: DataFrame, t: DataFrame, delta: int = 1, dist: str = "edit", most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Common subsequences after deletions on both sides: lcs needs delta of them in all, edit delta on each side."""
    a = _deletions(expand(s, most).select(F.col("id").alias("id1"), "toks"), "id1", delta)
    b = _deletions(t.select(F.col("id").alias("id2"), "toks"), "id2", delta).withColumnRenamed("lost", "lost2")
    hit = a.join(b, "toks")
    if dist == "lcs":
        found = hit.filter(F.col("lost") + F.col("lost2") <= delta).select("id1", "id2").distinct()
    else:
        found = verify(hit.select("id1", "id2").distinct(), s, t, "delta", delta=delta, dist=dist)
    return _and_large(found, s, most, lambda large: delta_simple(large, t, delta=delta, dist=dist))


def delta_simple_candidates(s: DataFrame, t: DataFrame, q: int, delta: int, use_lf: bool, most: int) -> DataFrame:
    a = _probe(s, qgrams.stpq(s, q)).withColumn("pos", F.explode(F.sequence(F.col("pos") - delta, F.col("pos") + delta))).distinct()
    b = _index(t, qgrams.pq(t, q))
    hit = a.join(b, ["pos", "gram"])
    if use_lf:
        hit = hit.filter(_length(delta))
    count = hit.groupBy("id1", "id2").agg(F.count_distinct("pos").alias("hits"), F.first("min_len").alias("min_len"), F.first("t_len").alias("t_len"))
    far = count.filter(F.col("hits") >= F.greatest("min_len", "t_len") - q * delta).select("id1", "id2")
    return far.unionByName(_short(s, t, delta, q * delta, most)).distinct()


def delta_simple(s: DataFrame, t: DataFrame, q: int = 2, delta: int = 1, dist: str = "edit", use_lf: bool = True, use_pqf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """q-grams at positions that differ by delta at most; an edit destroys q of them at most."""
    if not use_pqf:
        return all_pairs(s, t, delta, dist, most)
    return verify(delta_simple_candidates(s, t, q, delta, use_lf, most), s, t, "delta", delta=delta, dist=dist)


def variant_candidates(s: DataFrame, t: DataFrame, k: int, q: int, delta: int, best: bool, sample: float | None, seed: int, use_lf: bool, most: int) -> DataFrame:
    """Windows of q + delta tokens at one position share q tokens in order, at every position of t before the last delta tokens."""
    long = t.filter(F.size("toks") > delta)
    windows = qgrams.pq(long, q + delta).join(long.select("id", F.size("toks").alias("n")), "id").filter(F.col("pos") < F.col("n") - delta).drop("n")
    limit = None if best else k
    probe = qgrams.variants(qgrams.stpq(s, q + delta, limit), q, delta)
    if best:
        counted = probe if sample is None else qgrams.variants(qgrams.stpq(s.sample(sample, seed), q + delta), q, delta)
        counts = qgrams.gram_counts(counted.select("id", "pos", "gram").distinct())
        cost = qgrams.variants(windows, q, delta).select("id", "pos", "gram").distinct().join(counts, ["pos", "gram"], "left").groupBy("id", "pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        chosen = cost.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("n", "pos"))).filter(F.col("place") <= k).select("id", "pos")
        windows = windows.join(chosen, ["id", "pos"])
    else:
        windows = windows.filter(F.col("pos") < k)
    indexed = qgrams.variants(windows, q, delta).select("id", "pos", "gram").distinct()
    hit = _probe(s, probe.select("id", "pos", "gram").distinct()).join(_index(t, indexed), ["pos", "gram"])
    if use_lf:
        hit = hit.filter(_length(delta))
    count = hit.groupBy("id1", "id2").agg(F.count_distinct("pos").alias("hits"), F.first("indexed").alias("indexed"))
    return count.filter("hits >= indexed").select("id1", "id2").unionByName(_short(s, t, delta, delta, most)).distinct()


def delta_var(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2, delta: int = 1, dist: str = "edit", best: bool = False, sample: float | None = None, seed: int = 7, use_lf: bool = True, use_pqf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    if not use_pqf:
        return all_pairs(s, t, delta, dist, most)
    return verify(variant_candidates(s, t, k, q, delta, best, sample, seed, use_lf, most), s, t, "delta", delta=delta, dist=dist)


def delta_var_best(s: DataFrame, t: DataFrame, sample: float | None = None, **more) -> DataFrame:
    return delta_var(s, t, best=True, sample=sample, **more)


def delta_two_stage(s: DataFrame, t: DataFrame, k: int = 1, q: int = 2, delta: int = 1, dist: str = "edit", sample: float | None = None, seed: int = 7, use_lf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Pairs that both filters, variants and then q-grams, let through."""
    first = variant_candidates(s, t, k, q, delta, True, sample, seed, use_lf, most)
    second = delta_simple_candidates(s, t, q, delta, use_lf, most)
    return verify(first.join(second, ["id1", "id2"], "left_semi"), s, t, "delta", delta=delta, dist=dist)


def _segments(rows: DataFrame, key: str, delta: int) -> DataFrame:
    """(key, t_len, part, at, segment): each record in delta + 1 parts of even length."""
    n, p = F.size("toks"), delta + 1
    start = lambda i: F.floor(n * i / p).cast("int")
    parts = F.array(*(F.struct(F.lit(i).alias("part"), start(i).alias("at"), F.slice("toks", start(i) + 1, start(i + 1) - start(i)).alias("segment")) for i in range(p)))
    return rows.select(key, n.alias("t_len"), F.explode(parts).alias("p")).select(key, "t_len", "p.*")


def segment_join(made: DataFrame, t: DataFrame, delta: int) -> DataFrame:
    """(id1, id2): some segment of t stands in the other sequence, shifted by delta at most."""
    n, p = F.size("toks"), delta + 1
    d = made.withColumn("t_len", F.explode(F.sequence(F.greatest(F.lit(0), n - delta), n + delta))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(delta))))
    at, end = F.floor(F.col("t_len") * F.col("part") / p).cast("int"), F.floor(F.col("t_len") * (F.col("part") + 1) / p).cast("int")
    d = d.withColumn("at", at).withColumn("m", end - at)
    d = d.withColumn("from", F.explode(F.sequence(F.col("at") - delta, F.col("at") + delta))).filter((F.col("from") >= 0) & (F.col("from") + F.col("m") <= n))
    probe = d.select("id1", "t_len", "part", F.slice("toks", F.col("from") + 1, F.col("m")).alias("segment")).distinct()
    index = _segments(t.select(F.col("id").alias("id2"), "toks"), "id2", delta).select("id2", "t_len", "part", "segment")
    return probe.join(index, ["t_len", "part", "segment"]).select("id1", "id2").distinct()


def pass_join(s: DataFrame, t: DataFrame, delta: int = 0, dist: str = "edit", most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Pigeonhole: of delta + 1 segments of t, one is untouched by delta edits."""
    made = expand(s, most).select(F.col("id").alias("id1"), "toks")
    found = verify(segment_join(made, t, delta), s, t, "delta", delta=delta, dist=dist)
    return _and_large(found, s, most, lambda large: delta_simple(large, t, delta=delta, dist=dist))


def pass_join_plain(t: DataFrame, delta: int = 1, dist: str = "lcs") -> DataFrame:
    """Self join without rules: pairs id1 <= id2 within a distance."""
    found = segment_join(t.select(F.col("id").alias("id1"), "toks"), t, delta).filter("id1 <= id2")
    rules = t.withColumn("rules", F.array().cast("array<struct<start:int,n:int,rhs:array<string>>>"))
    return verify(found, rules, t, "distance", delta=delta, dist=dist)


# Jaccard classes


def jaccard_replace(s: DataFrame, t: DataFrame, theta: float = 0.8, rc: bool = False, use_lf: bool = True, most: int = MOST_TRANSFORMS, **_) -> DataFrame:
    """Greedy rules replace tokens; one of the rarest floor((1 - theta) n) + 1 tokens of t must be available to s."""
    b = orders.rarest(t, orders.rhs_counts(s), orders.prefix_size(theta)).select(F.col("id").alias("id2"), "token", "n_set")
    hit = _rhs_tokens(s).join(b, "token")
    if use_lf:
        hit = hit.filter(F.col("max_len") >= theta * F.col("n_set") - 1e-9)
    return verify(hit.select("id1", "id2").distinct(), s, t, "jaccard_greedy", theta=theta)


def jaccard_expand(s: DataFrame, t: DataFrame, theta: float = 0.8, check: str = "jaccard_selective", **_) -> DataFrame:
    """Rules of both sides add tokens. A common set of theta times the smaller set at least lies in both full sets, so prefixes of these meet.

    t: matched too.
    """
    both = full_set(s).unionByName(full_set(t)).select(F.explode("full").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefix(m: DataFrame, key: str) -> DataFrame:
        f = full_set(m).select("id", F.size("toks").alias("own"), "full")
        keyed = f.select("id", "own", F.size("full").alias("all"), F.explode("full").alias("token")).join(both, "token").withColumn("key", orders.frequency_key(F.col("n"), F.col("token")))
        d = keyed.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("key")))
        return d.filter(F.col("place") <= F.col("all") - F.ceil(theta * F.col("own") - 1e-9) + 1).select(F.col("id").alias(key), "token", F.col("own").alias(f"own_{key}"), F.col("all").alias(f"all_{key}"))

    hit = prefix(s, "id1").join(prefix(t, "id2"), "token")
    hit = hit.filter((F.col("all_id1") >= theta * F.col("own_id2") - 1e-9) & (F.col("all_id2") >= theta * F.col("own_id1") - 1e-9))
    return verify(hit.select("id1", "id2").distinct(), s, t, check, theta=theta)

