"""Strategies by name, and the run of a join in both directions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.rewrite import matched
from . import planner
from .spec import JoinSpec, Params

#: name: (strategy, parameters that it fixes)
STRATEGIES: dict[str, tuple[Callable, dict]] = {
    "JoinNaive": (joins.naive, {}),
    "JoinMH": (joins.first_k, {}),
    "JoinMin": (joins.best_k, {"sample": None}),
    "JoinMinFast": (joins.best_k_fast, {}),
    "JoinHybridAll": (planner.hybrid, {}),
    "SIJoin": (joins.si_tree, {}),
    "JoinPkduck": (joins.pkduck, {}),
    "PassJoin": (joins.pass_join, {}),
    "JoinSetNaive": (joins.set_naive, {}),
    "JoinPkduckSet": (joins.pkduck_set, {}),
    "JoinBKPSet": (joins.best_k_set, {}),
    "JoinPkduckOriginal": (joins.jaccard_replace, {}),
    "SIJoinOriginal": (joins.jaccard_expand, {}),
    "JoinDeltaNaive": (joins.delta_naive, {}),
    "JoinDeltaSimple": (joins.delta_simple, {}),
    "JoinDeltaVar": (joins.delta_var, {"sample": None}),
    "JoinDeltaVarBK": (joins.delta_var_best, {}),
    "JoinDeltaPQVPQ": (joins.delta_two_stage, {}),
    "JoinDeltaHybrid": (planner.delta_hybrid, {}),
}
SYMMETRIC = {"SIJoinOriginal"}


def one_direction(name: str, spec: JoinSpec) -> DataFrame:
    strategy, fixed = STRATEGIES[name]
    args = {k: v for k, v in spec.params.args().items() if not (k == "check" and v == "DP") and not (k == "sample" and v is None)} | fixed
    s = spec.searched()
    if name == "JoinPkduckOriginal" and spec.params.check != "DP":
        args.pop("check", None)
    if name in SYMMETRIC:
        args.pop("check", None)
        return strategy(s, matched(spec.right, spec.rules), **args)
    return strategy(s, spec.right, **args)


def run(name: str, spec: JoinSpec) -> DataFrame:
    """(id1, id2). Self join: ordered pairs, the pair of a record with itself among them; else, unless one-sided, both directions."""
    found = one_direction(name, spec)
    if spec.self_join:
        return found.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()
    if spec.one_side or name in SYMMETRIC:
        return found.distinct()
    back = one_direction(name, spec.reversed()).select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    return found.unionByName(back).distinct()


def join(name: str, left: DataFrame, right: DataFrame | None, rules: DataFrame, one_side: bool = False, **params) -> DataFrame:
    spec = JoinSpec.of_self(left, rules, **params) if right is None else JoinSpec(left, right, rules, one_side=one_side, params=Params(**params))
    return run(name, spec)


def with_params(spec: JoinSpec, **changes) -> JoinSpec:
    return JoinSpec(spec.left, spec.right, spec.rules, spec.self_join, spec.one_side, replace(spec.params, **changes))
