"""A stream of records joined with a static table: without state, so late or early records make no difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import token_set
from ..operators.rewrite import MOST_TRANSFORMS
from ..plans.registry import run
from ..plans.spec import JoinSpec, Params


def join_stream(stream: DataFrame, right: DataFrame, rules: DataFrame, name: str = "JoinNaive", sink: str | None = None, most: int = MOST_TRANSFORMS, **params):
    """A stream writer that joins each micro-batch of (id, raw, toks) and appends (id1, id2, batch) to `sink`.

    sink: a folder; it must be named. A repeated batch overwrites its own folder, so that retries leave each pair once.
    """

    if not sink:
        raise ValueError("sink: name the folder that takes the pairs")

    def one(batch: DataFrame, number: int) -> None:
        found = run(name, JoinSpec(batch, right, rules, one_side=True, params=Params(most=most, **params)))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(one)


def set_keys(stream: DataFrame) -> DataFrame:
    """(id, key) of a stream, to join token sets in append mode."""
    return stream.select("id", token_set(F.col("toks")).alias("key"))
