"""Connected components of large graphs: leaves are contracted first, the rest goes by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return r[0], r[1]


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node u to the smaller v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(e: DataFrame, most: int) -> DataFrame:
    """(u, root) of every node u of downward edges that is not the smallest of its component.

    A node's neighbours are never gathered: their minimum is aggregated before the shuffle and joined to the edges again, on a copy of
    the key, so that both sides are shuffled for the join and adaptive execution can deal a hub over tasks. Each round is
    written to the shared folder.
    """
    before, key = _mark(e), F.col("u").cast("string").alias("k")
    for _ in range(most):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(key, F.least("m", "u").alias("m"))
        large = both.filter("v > u").select("u", "v", key).join(low, "k").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("u", "v", key).join(least.select(key, "m"), "k").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stash(small.filter("u <> v").distinct(), "edges")
        unstash(e.sparkSession, e)
        e, now = new, _mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    return e.withColumnRenamed("v", "root")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(u, v) to a stashed (node, root): every node of an edge with the smallest of its component. No edges give no rows.

    Every node that has a smaller neighbour takes the smallest of them as its parent; its other smaller neighbours are tied to that parent
    instead. Nodes that are no one's smaller neighbour then hang from their parents alone and leave the graph, so that the rounds see
    hubs only.
    """
    e = stash(_downward(edges), "edges")
    parents = stash(e.groupBy("u").agg(F.min("v").alias("m")), "parents")
    key = F.col("u").cast("string").alias("k")
    ties = e.select("v", key).join(parents.select(key, "m"), "k").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hubs = e.select("v").distinct()
    kept = parents.join(hubs, parents["u"] == hubs["v"], "left_semi").select("u", F.col("m").alias("v"))
    roots = _stars(stash(_downward(ties.unionByName(kept)), "hubs"), most)
    upper = parents.join(roots.select(F.col("u").alias("m"), "root"), "m", "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root"))
    lowest = hubs.join(parents, hubs["v"] == parents["u"], "left_anti").join(roots, hubs["v"] == roots["u"], "left")
    out = stash(upper.unionByName(lowest.select(F.col("v").alias("node"), F.coalesce("root", "v").alias("root"))), "components")
    unstash(e.sparkSession, e, parents, roots)
    return out
