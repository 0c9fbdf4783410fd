"""Sinks: results as text, dictionaries, statistics as JSON lines or as aligned columns."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(pairs: DataFrame, left: DataFrame, right: DataFrame, self_join: bool) -> DataFrame:
    """(value): the number of pairs, then `text(id) == text(id)` for each; in self joins pairs of one id are counted only."""
    x = left.select(F.col("id").alias("id1"), F.col("raw").alias("a"))
    y = right.select(F.col("id").alias("id2"), F.col("raw").alias("b"))
    shown = pairs.filter("id1 <> id2") if self_join else pairs
    body = shown.join(x, "id1").join(y, "id2").select(F.format_string("%s (%d)\t==\t%s (%d)", "a", "id1", "b", "id2").alias("value"), F.lit(1).alias("k"), "id1", "id2")
    head = pairs.agg(F.count("*").cast("string").alias("value")).select("value", F.lit(0).alias("k"), F.lit(None).cast("long").alias("id1"), F.lit(None).cast("long").alias("id2"))
    return head.unionByName(body).orderBy("k", "id1", "id2").select("value")


def write_result(pairs: DataFrame, left: DataFrame, right: DataFrame, path: str, self_join: bool) -> None:
    result_lines(pairs, left, right, self_join).write.mode("overwrite").text(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.orderBy("token_id").write.mode("overwrite").csv(path, header=True)


def append_json(path: str, **sections: dict) -> None:
    """One line of JSON: date, dataset, algorithm, parameters, output."""
    with open(path, "a") as f:
        f.write(json.dumps(sections, default=str) + "\n")


def append_columns(path: str, stats: dict) -> None:
    """A row of values; a legend goes before it whenever the names change."""
    legend = "# " + " ".join(f"{i + 1}:{k}" for i, k in enumerate(stats))
    p = Path(path)
    old = [x for x in p.read_text().splitlines() if x.startswith("# ")] if p.exists() else []
    with p.open("a") as f:
        if not old or old[-1] != legend:
            f.write(legend + "\n")
        f.write(" ".join(map(str, stats.values())) + "\n")


def merge_stats(*all_stats: dict) -> dict:
    """Sums; the maximum of Mem_ names; the first of alg and Param_ names and of texts."""
    out: dict = {}
    for stats in all_stats:
        for k, v in stats.items():
            if k not in out or k.startswith(("alg", "Param_")) or isinstance(v, str):
                out.setdefault(k, v)
            else:
                out[k] = max(out[k], v) if k.startswith("Mem_") else out[k] + v
    return out


def read_json_map(path: str) -> dict[str, str]:
    return {k: str(v) for k, v in json.loads(Path(path).read_text()).items()}


def write_json_map(path: str, pairs: dict[str, str]) -> None:
    Path(path).write_text(json.dumps({k: str(v) for k, v in pairs.items()}))
