"""Applicable rules of records, and what follows from them.

`matched` is the form that all strategies start from: (id, toks, rules) with every applicable rule as (start, n, rhs), the
identity of each token included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewriting as R

#: Records with more segmentations than this are not expanded; joins find their pairs without expansion.
MOST_TRANSFORMS = 20_000_000
#: Records with more choices of added right-hand sides than this have no set expansions.
MOST_CHOICES = 4096
RULE = "struct<start:int,n:int,rhs:array<string>>"


def applicable(records: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, start, n, lhs, rhs) of the rules that occur in records: all runs of as many tokens as some lhs has, joined with the lhs."""
    widths = sorted(r[0] for r in rules.select(F.size("lhs")).distinct().collect())
    if not widths:
        return records.select("id", F.lit(0).alias("start"), F.lit(0).alias("n"), F.col("toks").alias("lhs"), F.col("toks").alias("rhs")).limit(0)
    at = lambda w: F.transform(
        F.when(F.size("toks") >= w, F.sequence(F.lit(0), F.size("toks") - w)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("start"), F.lit(w).alias("n"), F.slice("toks", i + 1, F.lit(w)).alias("lhs")),
    )
    grams = records.select("id", F.explode(F.flatten(F.array(*map(at, widths)))).alias("g")).select("id", "g.*")
    return grams.join(rules.select("lhs", "rhs").distinct(), "lhs").select("id", "start", "n", "lhs", "rhs")


def self_rules(records: DataFrame) -> DataFrame:
    """(lhs, rhs): the identity of every distinct token."""
    return records.select(F.explode("toks").alias("t")).distinct().select(F.array("t").alias("lhs"), F.array("t").alias("rhs"))


def matched(records: DataFrame, rules: DataFrame) -> DataFrame:
    found = applicable(records, rules).groupBy("id").agg(F.collect_list(F.struct("start", "n", "rhs")).alias("found"))
    own = F.transform("toks", lambda t, i: F.struct(i.alias("start"), F.lit(1).alias("n"), F.array(t).alias("rhs")))
    found_or_none = F.coalesce(F.col("found"), F.array().cast(f"array<{RULE}>"))
    return records.join(found, "id", "left").select("id", "toks", F.array_sort(F.array_distinct(F.concat(own.cast(f"array<{RULE}>"), found_or_none))).alias("rules"))


def _over_ends(step) -> Column:
    """A fold over the places 1..n of a record; step(acc, rules that end there) gives the next entry."""
    n = F.size("toks")
    ends = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return lambda first: F.aggregate(ends, first, lambda acc, e: F.array_append(acc, step(acc, F.filter("rules", lambda r: r["start"] + r["n"] == e))))


def min_lengths() -> Column:
    """Of each prefix of `toks`, the least length of its rewritings (n + 1 entries)."""
    return _over_ends(lambda acc, rs: F.array_min(F.transform(rs, lambda r: F.get(acc, r["start"]) + F.size(r["rhs"]))))(F.array(F.lit(0)))


def max_lengths() -> Column:
    return _over_ends(lambda acc, rs: F.array_max(F.transform(rs, lambda r: F.get(acc, r["start"]) + F.size(r["rhs"]))))(F.array(F.lit(0)))


def num_transforms() -> Column:
    """Segmentations of `toks`, an upper bound of distinct rewritings; stays at the greatest long."""
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = lambda acc, rs: F.least(top, F.aggregate(rs, F.lit(0).cast("decimal(38,0)"), lambda s, r: F.least(top, s + F.get(acc, r["start"])).cast("decimal(38,0)")))
    return F.element_at(_over_ends(total)(F.array(F.lit(1).cast("decimal(38,0)"))), -1).cast("long")


def profiled(m: DataFrame) -> DataFrame:
    """matched with min_len, max_len, transforms."""
    return m.withColumns({"min_len": F.element_at(min_lengths(), -1), "max_len": F.element_at(max_lengths(), -1), "transforms": num_transforms()})


def num_applicable(m: DataFrame) -> DataFrame:
    """(id, rules): applicable rules that change something."""
    same = lambda r: F.slice("toks", r["start"] + 1, r["n"]) == r["rhs"]
    return m.select("id", F.size(F.filter("rules", lambda r: ~same(r))).cast("long").alias("rules"))


def by_end(m: DataFrame) -> DataFrame:
    """(id, end, n, rhs): rules by the place of their last token."""
    return m.select("id", F.explode("rules").alias("r")).select("id", (F.col("r.start") + F.col("r.n") - 1).alias("end"), "r.n", "r.rhs")


def available_tokens(m: DataFrame) -> DataFrame:
    """(id, pos, token): tokens that can stand at a position of some rewriting, as far as lengths tell."""
    low, high = min_lengths(), max_lengths()
    r = m.withColumns({"low": low, "high": high}).select("id", "low", "high", F.explode("rules").alias("r")).select("id", F.get("low", F.col("r.start")).alias("a"), F.get("high", F.col("r.start")).alias("b"), F.posexplode("r.rhs").alias("i", "token"))
    return r.select("id", F.explode(F.sequence(F.col("a") + F.col("i"), F.col("b") + F.col("i"))).alias("pos"), "token").distinct()


def _rules(value: list) -> list[R.Rule]:
    return [(r["start"], r["n"], tuple(r["rhs"])) for r in value]


def expand(m: DataFrame, most: int = MOST_TRANSFORMS) -> DataFrame:
    """(id, toks): E(s) without repeats. Records of more than `most` segmentations are left out, see skipped()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, toks, rules in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                made = list(R.expand(len(toks), _rules(rules)))
                for lo in range(0, len(made), 20_000):
                    part = made[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), pa.array(part, pa.list_(pa.string()))], ["id", "toks"])

    return searchable(m, most).mapInArrow(run, "id long, toks array<string>")


def searchable(m: DataFrame, most: int = MOST_TRANSFORMS) -> DataFrame:
    return m.filter(num_transforms() <= most).select("id", "toks", "rules")


def skipped(m: DataFrame, most: int = MOST_TRANSFORMS) -> DataFrame:
    """(id) of the records that are not expanded."""
    return m.filter(num_transforms() > most).select("id")


def _set_choices() -> Column:
    """Choices of the distinct rhs that add a token."""
    return F.pow(F.lit(2.0), F.size(F.array_distinct(F.filter(F.transform("rules", lambda r: r["rhs"]), lambda x: F.size(F.array_except(x, F.col("toks"))) > 0))))


def set_skipped(m: DataFrame, most: int = MOST_CHOICES) -> DataFrame:
    """(id) of the records that set_expansions leaves out."""
    return m.filter(_set_choices() > most).select("id")


def set_expansions(m: DataFrame, most: int = MOST_CHOICES) -> DataFrame:
    """(id, toks): the record's token set with the rhs of every choice of rules added, sorted. Records of more than `most` choices are left out, see set_skipped()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, toks, rules in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                made = [sorted(s) for s in R.all_set_expansions(tuple(toks), _rules(rules))]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(made), pa.int64()), pa.array(made, pa.list_(pa.string()))], ["id", "toks"])

    return m.filter(_set_choices() <= most).mapInArrow(run, "id long, toks array<string>")


def full_set(m: DataFrame) -> DataFrame:
    """(id, toks, full): all rules added."""
    return m.select("id", F.array_distinct("toks").alias("toks"), F.array_distinct(F.concat(F.col("toks"), F.flatten(F.transform("rules", lambda r: r["rhs"])))).alias("full"))


def random_transform(m: DataFrame, seed: int = 7) -> DataFrame:
    """(id, toks): one rewriting of each record, choosing among a place's rules by a seeded digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random

        for b in batches:
            out = []
            for i, toks, rules in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rng, at, made = random.Random(f"{seed}:{i}"), 0, []
                start: dict[int, list] = {}
                for r in _rules(rules):
                    start.setdefault(r[0], []).append(r)
                while at < len(toks):
                    r = rng.choice(start[at])
                    made += r[2]
                    at += r[1]
                out.append(made)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["id", "toks"])

    return m.select("id", "toks", "rules").mapInArrow(run, "id long, toks array<string>")
