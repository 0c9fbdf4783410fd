"""Global orders of tokens and the choices that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rhs_counts(m: DataFrame) -> DataFrame:
    """(token, n): how often tokens stand in the right-hand sides of applicable rules."""
    return m.select(F.explode(F.flatten(F.transform("rules", lambda r: r["rhs"]))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def frequency_first(m: DataFrame) -> DataFrame:
    """(token, n, rank): rarest first, equal counts by token.

    Ranks are dense over the whole dictionary, so its rows (tokens, not records) are ordered together.
    """
    return rhs_counts(m).withColumn("rank", F.row_number().over(W.orderBy("n", "token")).cast("long"))


def frequency_key(n: Column, token: Column) -> Column:
    """A text that sorts as the rank does; it needs no global numbering. Tokens without a count come last."""
    return F.concat(F.lpad(F.coalesce(n, F.lit(10**18 - 1)).cast("string"), 18, "0"), F.lit(":"), token)


def keyed_tokens(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, pos, token, key) of each record's tokens."""
    t = records.select("id", F.posexplode("toks").alias("pos", "token"))
    return t.join(counts, "token", "left").select("id", "pos", "token", frequency_key(F.col("n"), F.col("token")).alias("key"))


def position_first(records: DataFrame, m: DataFrame) -> DataFrame:
    """(id, pos, token, place): the order by position, then rank, as each record's tokens stand in it."""
    k = keyed_tokens(records, rhs_counts(m))
    return k.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("pos", "key")).cast("long")).drop("key")


def rarest(records: DataFrame, counts: DataFrame, k: Column | int) -> DataFrame:
    """(id, token, place): the first k distinct tokens of each record in the order of frequency; k may use `n_set`, the set's size."""
    d = keyed_tokens(records, counts).groupBy("id", "token", "key").agg(F.lit(1).alias("one"))
    own = W.partitionBy("id")
    d = d.withColumn("n_set", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("key")).cast("long"))
    return d.filter(F.col("place") <= (F.lit(k) if isinstance(k, int) else k)).select("id", "token", "key", "place", "n_set")


def prefix_size(theta: float) -> Column:
    """Tokens of a set of n_set of which one must be shared at similarity theta."""
    return F.floor((1 - theta) * F.col("n_set") + 1e-9) + 1


def best_positions(grams: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(id, pos, gram, n) of the k positions of each record whose gram is rarest; equal counts: the earlier position."""
    d = grams.join(counts, ["pos", "gram"], "left").fillna(0, ["n"])
    return d.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("n", "pos"))).filter(F.col("place") <= k).drop("place")


def dictionary(records: DataFrame) -> DataFrame:
    """(token, token_id): every distinct token, numbered in order; 0 is the empty token."""
    t = records.select(F.explode("toks").alias("token")).filter("token <> ''").distinct()
    return t.withColumn("token_id", F.row_number().over(W.orderBy("token")).cast("long")).unionByName(records.sparkSession.createDataFrame([("", 0)], "token string, token_id long"))


def encode(records: DataFrame, words: DataFrame) -> DataFrame:
    """(id, ids): token ids in place of tokens."""
    t = records.select("id", F.posexplode("toks").alias("pos", "token")).join(words, "token")
    return t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("x")).select("id", F.transform("x", lambda s: s["token_id"]).alias("ids"))


def decode(encoded: DataFrame, words: DataFrame) -> DataFrame:
    t = encoded.select("id", F.posexplode("ids").alias("pos", "token_id")).join(words, "token_id")
    return t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x")).select("id", F.transform("x", lambda s: s["token"]).alias("toks"))
