"""Seeded synthetic data: a Zipf dictionary, rules, records that rules apply to, and perturbed copies."""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Zipf:
    """Ranks 0..n-1 of probability 1 / (rank + 1) ** skew, by the inverse of the distribution."""

    def __init__(self, n: int, skew: float):
        total, self.upto = 0.0, []
        for k in range(1, n + 1):
            total += k**-skew
            self.upto.append(total)

    def draw(self, rng: random.Random) -> int:
        return min(bisect.bisect_left(self.upto, rng.random() * self.upto[-1]), len(self.upto) - 1)


def rules(spark: SparkSession, n: int, tokens: int, most_lhs: int = 2, most_rhs: int = 2, skew: float = 0.0, seed: int = 7) -> DataFrame:
    """(rule_id, lhs, rhs) of different sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Zipf(tokens, skew)
        for b in batches:
            lhs, rhs = [], []
            for i in b.column(0).to_pylist():
                rng = random.Random(f"rule:{seed}:{i}")
                while True:
                    a, c = ([f"t{z.draw(rng)}" for _ in range(rng.randint(1, m))] for m in (most_lhs, most_rhs))
                    if a != c:
                        break
                lhs.append(a)
                rhs.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lhs), pa.array(rhs)], ["rule_id", "lhs", "rhs"])

    return spark.range(n).mapInArrow(run, "rule_id long, lhs array<string>, rhs array<string>")


def records(spark: SparkSession, n: int, tokens: int, mean_len: int = 5, skew: float = 1.0, rule_sides: list[list[str]] = (), rules_per_record: float = 0.0, equivalent: float = 0.0, seed: int = 7) -> DataFrame:
    """(id, raw, toks): Zipf tokens; rules_per_record: left-hand sides planted on average; equivalent: the share that repeats the record before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Zipf(tokens, skew)

        def make(i: int) -> list[str]:
            rng = random.Random(f"record:{seed}:{i}")
            if i and rng.random() < equivalent:
                return make(i - 1)
            size, out = max(1, round(rng.gauss(mean_len, 1))), []
            planted = int(rules_per_record) + (rng.random() < rules_per_record % 1)
            for _ in range(planted if rule_sides else 0):
                out += rng.choice(rule_sides)
            while len(out) < size:
                out.append(f"t{z.draw(rng)}")
            return out

        for b in batches:
            made = [make(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(x) for x in made]), pa.array(made, pa.list_(pa.string()))], ["id", "raw", "toks"])

    return spark.range(n).mapInArrow(run, "id long, raw string, toks array<string>")


def perturbed(m: DataFrame, seed: int = 7) -> DataFrame:
    """(id, kind, toks): the record, a random rewriting of it, it without one token, it shuffled, it without its last token."""
    from ..operators.rewrite import random_transform

    at = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.greatest(F.size("toks"), F.lit(1))).cast("int")
    key = lambda i: F.xxhash64(F.col("id"), i, F.lit(seed))
    shuffled = F.transform(F.array_sort(F.transform("toks", lambda t, i: F.struct(key(i).alias("k"), t.alias("t")))), lambda s: s["t"])
    kinds = [("original", F.col("toks")), ("one_removed", F.filter("toks", lambda _, i: i != at)), ("shuffled", shuffled), ("last_removed", F.slice("toks", 1, F.greatest(F.size("toks") - 1, F.lit(0))))]
    out = random_transform(m, seed).select("id", F.lit("equivalent").alias("kind"), "toks")
    for name, c in kinds:
        out = out.unionByName(m.select("id", F.lit(name).alias("kind"), c.alias("toks")))
    return out
