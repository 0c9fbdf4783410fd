"""Verifiers of candidate pairs: columns where the JVM can express them, else Arrow batches over functions without shared state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewriting as R
from ..functions.arrays import edit_distance, indel_distance
from .rewrite import _rules

#: name: predicate (x tokens, x rules, y tokens, y rules, parameters)
PREDICATES: dict[str, Callable] = {
    "same": lambda x, rx, y, ry, p: x == y,
    "sequence": lambda x, rx, y, ry, p: R.reaches(len(x), rx, y),
    "sequence_naive": lambda x, rx, y, ry, p: y in R.expand(len(x), rx),
    "sequence_greedy": lambda x, rx, y, ry, p: R.greedy_sequence(len(x), rx, y),
    "both": lambda x, rx, y, ry, p: R.both_reach(len(x), rx, len(y), ry),
    "both_naive": lambda x, rx, y, ry, p: not R.expand(len(x), rx).isdisjoint(R.expand(len(y), ry)),
    "delta": lambda x, rx, y, ry, p: R.nearest(len(x), rx, y, p["dist"] == "edit") <= p["delta"],
    "delta_naive": lambda x, rx, y, ry, p: any(R.distance(e, y, p["dist"] == "edit") <= p["delta"] for e in R.expand(len(x), rx)),
    "distance": lambda x, rx, y, ry, p: R.distance(x, y, p["dist"] == "edit") <= p["delta"],
    "set": lambda x, rx, y, ry, p: R.set_reaches(len(x), rx, y),
    "set_naive": lambda x, rx, y, ry, p: any(set(e) == set(y) for e in R.expand(len(x), rx)),
    "set_beam": lambda x, rx, y, ry, p: R.set_beam(len(x), rx, y, p.get("beam", 2)),
    "set_greedy": lambda x, rx, y, ry, p: R.greedy_set(len(x), rx, y),
    "jaccard_greedy": lambda x, rx, y, ry, p: R.greedy_jaccard(x, rx, y) >= p["theta"],
    "jaccard_selective": lambda x, rx, y, ry, p: R.selective_expansion(x, rx, y, ry, p["theta"]) >= p["theta"],
    "jaccard_exact": lambda x, rx, y, ry, p: R.best_set_expansion(x, rx, y, ry) >= p["theta"],
    "jaccard_full": lambda x, rx, y, ry, p: R._jac(set(x).union(*(r[2] for r in rx)), set(y).union(*(r[2] for r in ry))) >= p["theta"],
}


#: How many tokens of y may be out of the reach of x's rules, by predicate; others are not limited.
REACH = {"sequence": 0, "sequence_naive": 0, "sequence_greedy": 0, "set": 0, "set_naive": 0, "set_beam": 0, "set_greedy": 0, "delta": "delta", "delta_naive": "delta"}


def _reachable(name: str, parameters: dict):
    """A condition that any pair of the predicate meets, in the JVM: y has few tokens that no rule of x gives."""
    if name not in REACH:
        return F.lit(True)
    most = REACH[name] if isinstance(REACH[name], int) else parameters[REACH[name]]
    return F.size(F.filter("y", lambda t: ~F.array_contains("reach", t))) <= most


def reaches() -> Column:
    """y is a rewriting of x by its rules rx: the lengths of prefixes of y that prefixes of x can become, by a fold over x."""
    n = F.size("x")
    ends = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, e: Column) -> Column:
        grow = lambda r: F.transform(F.filter(F.get(acc, r["start"]), lambda j: F.slice("y", j + 1, F.size(r["rhs"])) == r["rhs"]), lambda j: j + F.size(r["rhs"]))
        return F.array_append(acc, F.array_distinct(F.flatten(F.transform(F.filter("rx", lambda r: r["start"] + r["n"] == e), grow))))

    return F.array_contains(F.element_at(F.aggregate(ends, F.array(F.array(F.lit(0))), step), -1), F.size("y"))


#: Predicates as columns over x, rx, y; these need no Python.
COLUMNS: dict[str, Callable[[dict], Column]] = {
    "same": lambda p: F.col("x") == F.col("y"),
    "sequence": lambda p: reaches(),
    "distance": lambda p: (edit_distance if p["dist"] == "edit" else indel_distance)(F.col("x"), F.col("y")) <= p["delta"],
}


class _Seen:
    """Records of a task by a hash of all that they hold, so that each is turned into Python once however many candidates it has; bounded.

    An id that stands for several records is as many entries.
    """

    def __init__(self, key: str, toks: str, rules: str, most: int = 100_000):
        self.key, self.toks, self.rules, self.most = key, toks, rules, most
        self.known: dict[int, tuple] = {}

    def of(self, b: pa.RecordBatch) -> list[tuple]:
        if len(self.known) > self.most:
            self.known.clear()
        keys, first = np.unique(b.column(self.key).to_numpy(), return_index=True)
        new = [(i, k) for i, k in zip(keys.tolist(), first.tolist(), strict=True) if i not in self.known]
        if new:
            rows = pa.array([k for _, k in new], pa.int64())
            toks, rules = (b.column(c).take(rows).to_pylist() for c in (self.toks, self.rules))
            self.known.update({i: (tuple(t), _rules(r)) for (i, _), t, r in zip(new, toks, rules, strict=True)})
        return [self.known[i] for i in b.column(self.key).to_pylist()]


def verify(candidates: DataFrame, left: DataFrame, right: DataFrame, name: str, **parameters) -> DataFrame:
    """The candidates (id1, id2) that satisfy a predicate; left: (id, toks, rules); right: (id, toks[, rules]).

    Where an id stands for several records, a pair is given if any of them satisfy it, once for each that does.
    """
    test = PREDICATES[name]
    reach = F.array_distinct(F.flatten(F.transform("rules", lambda r: r["rhs"]))).alias("reach")
    x = left.select(F.col("id").alias("id1"), F.col("toks").alias("x"), F.col("rules").alias("rx"), reach)
    ry = F.col("rules") if "rules" in right.columns else F.array().cast("array<struct<start:int,n:int,rhs:array<string>>>")
    y = right.select(F.col("id").alias("id2"), F.col("toks").alias("y"), ry.alias("ry"))
    pairs = candidates.join(x, "id1").join(y, "id2").filter(_reachable(name, parameters))
    if name in COLUMNS:
        return pairs.filter(COLUMNS[name](parameters)).select("id1", "id2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_seen, right_seen = _Seen("k1", "x", "rx"), _Seen("k2", "y", "ry")
        for b in batches:
            mask = pa.array([bool(test(*one, *two, parameters)) for one, two in zip(left_seen.of(b), right_seen.of(b), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id1").filter(mask), b.column("id2").filter(mask)], ["id1", "id2"])

    keys = F.xxhash64("id1", "x", "rx").alias("k1"), F.xxhash64("id2", "y", "ry").alias("k2")
    return pairs.select("id1", "id2", *keys, "x", "rx", "y", "ry").mapInArrow(run, "id1 long, id2 long")
