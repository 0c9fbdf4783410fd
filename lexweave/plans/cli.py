"""Command line: a join of text files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from ..sources import sinks, text
from . import quality, registry
from .spec import JoinSpec, Params


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description="Join two files of records under rewrite rules.")
    for name in ("rulePath", "dataOnePath", "dataTwoPath", "outputPath", "algorithm"):
        p.add_argument(f"-{name}", required=True)
    p.add_argument("-oneSideJoin", default="false")
    p.add_argument("-groundPath")
    p.add_argument("-statPath")
    p.add_argument("-additional", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    self_join = a.dataOnePath == a.dataTwoPath
    left = text.read_records(spark, a.dataOnePath)
    right = left if self_join else text.read_records(spark, a.dataTwoPath)
    spec = JoinSpec(left, right, text.read_rules(spark, a.rulePath), self_join, a.oneSideJoin.lower() == "true", Params.parse(a.additional))
    began = time.time()
    found = registry.run(a.algorithm, spec)
    sinks.write_result(found, left, right, a.outputPath, self_join)
    out = {"Date": time.strftime("%Y-%m-%d %H:%M:%S"), "Dataset": {"one": a.dataOnePath, "two": a.dataTwoPath, "rules": a.rulePath}, "Algorithm": a.algorithm, "Param": spec.params.args(), "Output": {"seconds": time.time() - began, "pairs": found.count()}}
    if a.groundPath:
        s = spec.searched()
        out["Quality"] = quality.scores(*quality.confusion(found, text.read_pairs(spark, a.groundPath), s, right, self_join)).first().asDict()
    if a.statPath:
        sinks.append_json(a.statPath, **out)
    return out


if __name__ == "__main__":
    main()
