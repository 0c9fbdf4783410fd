"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only.

Sources stand in the order of their code points, null last, and weigh 1, 2, 3, 1, 2, 3, ... A source's target is its share
of all words by weight; where that is above `max_epochs` times its words, it stays at this cap and the excess goes to
the others by weight, until none is above. The final level has a closed form: with the sources ordered by cap / weight,
it is (total - caps before) / (weights from here on), at the first place where that is no more than the place's own ratio.

A source's target, as whole words, is w whole repetitions of every document plus a remainder. The remainder goes to
the documents in the order of a seeded digest of their ids; the last of them gives a fraction of itself. The order is found without sorting
a source: ranges of digests (4,096, more with more rows) are summed before the shuffle, and only the range where the remainder ends is sorted.

Defined cases: null and empty texts have size 0 and nothing is taken of them; a source of no words has target 0; null
is a source of its own; equal ids of one source are ordered by size, and equal rows are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, unstash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); one row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    t = totals.select("source", "source_size", weight.cast("double").alias("weight"))
    t = t.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, on = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    t = t.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    final = F.min(F.when(F.col("fits"), F.struct("ratio", "level"))).over(every)["level"]
    return t.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", carry: tuple[str, ...] = (), most_sources: int = 100_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every row of docs(doc_id, text, source).

    carry: further columns of docs that the rows keep, in column `row`; rows that carry them move only in the one range of a source
    where its remainder ends. most_sources: the table of sources, a short row each, is broadcast up to this number, else joined.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *([F.struct(*carry).alias("row")] if carry else []))
    if not carry:
        sizes = stash(sizes, "sizes")
    row = ["row"] if carry else []
    n, digits = sizes.select("doc_id").count(), 3
    while n >> 4 * digits > 1 << 16:
        digits += 1
    d = sizes.withColumn("u", digest).withColumn("part", F.substring("u", 1, digits))
    parts = stash(d.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    totals = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    whole = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    targets = targets.withColumn("words", whole).withColumn("reps", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("words") - F.col("reps") * F.col("source_size"))
    run = F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    p, t = parts.withColumn("upto", run).alias("p"), targets.alias("t")
    start = F.col("upto") - F.col("part_size")
    cut = (start < F.col("rest")) & (F.col("rest") < F.col("upto"))
    ends = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).groupBy("p.source", "t.source_size", "target", "reps", "rest")
    plan = stash(ends.agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("part"))).alias("last_part"), F.max(F.when(cut, F.col("part"))).alias("cut_part"), F.max(F.when(cut, start)).alias("start")), "plan")
    unstash(docs.sparkSession, parts)
    small = F.broadcast(plan) if plan.count() <= most_sources else plan
    d = d.alias("d").join(small.alias("q"), F.expr("d.source <=> q.source")).select("d.doc_id", "d.source", "size", *row, "u", "d.part", "last_part", "cut_part", "start", "source_size", "target", "reps", "rest")
    at_cut = F.coalesce(F.col("part") == F.col("cut_part"), F.lit(False))
    clear = d.filter(~at_cut).withColumn("extra", F.when(F.col("part") <= F.col("last_part"), F.col("size")).otherwise(F.lit(0)))
    within = W.partitionBy("source", "part").orderBy("u", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    split = d.filter(at_cut).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - at)))
    taken = (F.col("reps") * F.col("size") + F.col("extra")).cast("long")
    return clear.unionByName(split).select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), *row)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, whole, with size, source_size, target and taken; where docs has such a column, the mix's own is named mix_NAME."""
    m = mix_sources(docs, weights, max_epochs, seed, carry=tuple(docs.columns)).filter("taken > 0")
    names = {c.lower() for c in docs.columns}
    new = []
    for c in ("size", "source_size", "target", "taken"):
        name = c
        while name.lower() in names:
            name = f"mix_{name}"
        new.append(F.col(c).alias(name))
    return m.select(*[F.col("row")[c].alias(c) for c in docs.columns], *new)


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM totals),
rounds AS (
  SELECT 0 AS n, source, source_size, weight, cap, total, false AS held, total * weight / sum(weight) OVER () AS share FROM weighed
  UNION ALL
  SELECT n + 1, source, source_size, weight, cap, total, held OR share > cap,
         CASE WHEN held OR share > cap THEN cap
              ELSE (total - coalesce(sum(cap) FILTER (WHERE held OR share > cap) OVER (), 0)) * weight / sum(weight) FILTER (WHERE NOT (held OR share > cap)) OVER () END
  FROM rounds WHERE n < (SELECT count(*) FROM weighed)),
final AS (SELECT source, source_size, least(cap, share) AS target FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN w // source_size ELSE 0 END AS reps
  FROM (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS w FROM final)),
run AS (
  SELECT s.*, g.source_size, g.target, g.reps, g.w - g.reps * g.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(reps * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM run
"""
