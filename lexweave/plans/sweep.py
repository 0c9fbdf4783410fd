"""A sweep of strategies over parameter grids."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import run as join
from .registry import with_params
from .spec import JoinSpec


def run(spark: SparkSession, spec: JoinSpec, grid: dict[str, list[dict]]) -> DataFrame:
    """(strategy, parameters, pairs): a row for each strategy and parameter set."""
    out = None
    for name, choices in grid.items():
        for changes in choices:
            n = join(name, with_params(spec, **changes)).agg(F.count("*").alias("pairs"))
            row = n.select(F.lit(name).alias("strategy"), F.lit(json.dumps(changes)).alias("parameters"), "pairs")
            out = row if out is None else out.unionByName(row)
    return out
