import random

import pytest

from lexweave.functions import rewriting as R
from lexweave.operators import joins, rewrite
from lexweave.plans import planner, registry
from lexweave.plans.spec import JoinSpec, Params
from lexweave.sources import text
from test_rewriting import brute, rules_for

GIVEN = [("a b", "c"), ("a", "d"), ("c", "a b"), ("b c", "c b d"), ("d d", "a"), ("e", "b")]


def rows(seed, n=40):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(n)})


def frame(spark, values):
    return text.with_tokens(spark.createDataFrame(list(enumerate(values)), "id long, raw string"))


@pytest.fixture(scope="module")
def data(spark):
    left, right = rows(1), rows(2)
    given = [(tuple(a.split()), tuple(b.split())) for a, b in GIVEN]
    sides = []
    for values in (left, right):
        toks = [tuple(v.split()) for v in values]
        rules = [rules_for(t, given) for t in toks]
        sides.append((toks, rules, [brute(t, r) for t, r in zip(toks, rules, strict=True)]))
    return {"frames": (frame(spark, left).cache(), frame(spark, right).cache()), "rules": text.rules_of(spark, GIVEN).cache(), "sides": sides}


def expected(data, test, self_join):
    (xs, xr, xe), (ys, yr, ye) = data["sides"]
    one = lambda a, ar, ae, b: {(i, j) for i in range(len(a)) for j in range(len(b)) if test(a[i], ar[i], ae[i], b[j])}
    if self_join:
        return {(min(p), max(p)) for p in one(xs, xr, xe, xs)}
    return one(xs, xr, xe, ys) | {(i, j) for j, i in one(ys, yr, ye, xs)}


def spec(data, self_join, **params):
    a, b = data["frames"]
    return JoinSpec(a, a if self_join else b, data["rules"], self_join, params=Params(**params))


def pairs(df):
    got = [(r.id1, r.id2) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


SEQUENCE = [("JoinNaive", {}), ("JoinMH", {"k": 1, "q": 1}), ("JoinMH", {"k": 3, "q": 2}), ("JoinMin", {"k": 2, "q": 2}), ("JoinMinFast", {"sample": 0.01}), ("JoinHybridAll", {"sample_plan": 1.0}), ("SIJoin", {}), ("JoinPkduck", {"order": "PF"}), ("JoinPkduck", {"check": "naive", "use_lf": False}), ("PassJoin", {})]
SETS = [("JoinSetNaive", {}), ("JoinPkduckSet", {}), ("JoinBKPSet", {"k": 3})]
DELTA = [("JoinDeltaNaive", {}), ("JoinDeltaSimple", {"q": 1}), ("JoinDeltaSimple", {"q": 2}), ("JoinDeltaVar", {"k": 2, "q": 1}), ("JoinDeltaVar", {"k": 1, "q": 2}), ("JoinDeltaVarBK", {"k": 2, "q": 2, "sample": 0.5}), ("JoinDeltaPQVPQ", {"q": 1}), ("JoinDeltaHybrid", {"sample_plan": 1.0}), ("PassJoin", {}), ("JoinDeltaVar", {"use_pqf": False})]


@pytest.mark.parametrize(("name", "params"), SEQUENCE)
@pytest.mark.parametrize("self_join", [True, False])
def test_sequence_class(data, name, params, self_join):
    assert pairs(registry.run(name, spec(data, self_join, **params))) == expected(data, lambda x, rx, ex, y: y in ex, self_join)


@pytest.mark.parametrize(("name", "params"), SETS)
def test_set_class(data, name, params):
    assert pairs(registry.run(name, spec(data, False, **params))) == expected(data, lambda x, rx, ex, y: any(set(e) == set(y) for e in ex), False)


@pytest.mark.parametrize(("name", "params"), DELTA)
@pytest.mark.parametrize(("delta", "dist"), [(1, "edit"), (1, "lcs"), (2, "edit"), (2, "lcs")])
def test_delta_class(data, name, params, delta, dist):
    if delta == 2 and name in ("JoinDeltaHybrid", "JoinDeltaPQVPQ"):
        pytest.skip("made of parts that are tested")
    want = expected(data, lambda x, rx, ex, y: min(R.distance(e, y, dist == "edit") for e in ex) <= delta, True)
    assert pairs(registry.run(name, spec(data, True, delta=delta, dist=dist, **params))) == want


def test_jaccard_classes(data):
    want = expected(data, lambda x, rx, ex, y: R.greedy_jaccard(x, rx, y) >= 0.6, True)
    assert pairs(registry.run("JoinPkduckOriginal", spec(data, True, theta=0.6))) == want
    (xs, xr, _), (ys, yr, _) = data["sides"]
    want = {(i, j) for i in range(len(xs)) for j in range(len(ys)) if R.selective_expansion(xs[i], xr[i], ys[j], yr[j], 0.6) >= 0.6}
    assert pairs(registry.run("SIJoinOriginal", spec(data, False, theta=0.6))) == want


@pytest.mark.parametrize("name", ["greedy", "MIT_GR", "beam"])
def test_approximate_strategies_are_subsets(data, name):
    exact = expected(data, lambda x, rx, ex, y: any(set(e) == set(y) for e in ex), True)
    assert pairs(registry.run("JoinBKPSet" if name != "greedy" else "JoinPkduckSet", spec(data, True, check=name))) <= exact


def test_first_positions_lose_no_pair(spark):
    r, rules = frame(spark, ["a b", "x b"]), text.rules_of(spark, [("a b", "c"), ("a", "x")])
    for k in (1, 2, 3):
        for q in (1, 2, 3):
            assert pairs(registry.run("JoinMH", JoinSpec.of_self(r, rules, k=k, q=q))) == {(0, 0), (0, 1), (1, 1)}


def test_every_plan_gives_the_same_pairs(data):
    s = spec(data, True).searched()
    t = data["frames"][0]
    want = pairs(joins.naive(s, t))
    for threshold in (0, 2, 10**6):
        for index in ("first", "best"):
            assert pairs(planner.hybrid(s, t, plan=planner.Plan(threshold, index))) == want


def test_cut_off_is_a_parameter(data):
    s = spec(data, True).searched()
    few = {r.id for r in rewrite.skipped(s, 2).collect()}
    assert few and not few & {r.id for r in rewrite.expand(s, 2).select("id").distinct().collect()}


def test_plain_segments(data):
    toks = data["sides"][0][0]
    want = {(i, j) for i in range(len(toks)) for j in range(i, len(toks)) if R.distance(toks[i], toks[j], False) <= 2}
    assert pairs(joins.pass_join_plain(data["frames"][0], 2, "lcs")) == want


def test_empty_tables(spark, data):
    none = data["frames"][0].limit(0)
    for name in ("JoinNaive", "JoinMH", "JoinMin", "JoinHybridAll", "SIJoin", "JoinBKPSet", "JoinDeltaVar", "JoinDeltaHybrid", "SIJoinOriginal"):
        assert not registry.run(name, JoinSpec.of_self(none, data["rules"], delta=1 if "Delta" in name else 0)).collect()
    assert pairs(registry.run("JoinNaive", JoinSpec.of_self(data["frames"][0], data["rules"].limit(0)))) == {(i, i) for i in range(data["frames"][0].count())}


def test_no_nested_loop_and_no_python_in_native_parts(data):
    plan = registry.run("JoinMin", spec(data, True))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_records_without_set_expansions_are_listed(spark):
    r, rules = frame(spark, ["a b", "b"]), text.rules_of(spark, [("a", f"x{i}") for i in range(13)])
    m = rewrite.matched(r, rules)
    assert {x.id for x in rewrite.set_skipped(m).collect()} == {0}
    assert {x.id for x in rewrite.set_expansions(m).collect()} == {1}
    assert not rewrite.set_skipped(m, 1 << 13).collect()


def test_a_repeated_id_is_several_records(spark):
    from lexweave.operators.verify import PREDICATES, verify

    rule = "struct<start:int,n:int,rhs:array<string>>"
    left = spark.createDataFrame([(1, ["a"], [(0, 1, ["a"])]), (1, ["b"], [(0, 1, ["b"])])], f"id long, toks array<string>, rules array<{rule}>")
    right = spark.createDataFrame([(7, ["b"], [(0, 1, ["b"])])], f"id long, toks array<string>, rules array<{rule}>")
    pairs = spark.createDataFrame([(1, 7)], "id1 long, id2 long")
    for name in PREDICATES:
        got = verify(pairs, left, right, name, delta=0, dist="edit", theta=1.0).distinct().collect()
        assert [tuple(r) for r in got] == [(1, 7)], name


@pytest.mark.parametrize(("name", "params"), [("JoinNaive", {}), ("JoinMH", {"use_stpq": False}), ("JoinSetNaive", {}), ("JoinDeltaNaive", {"delta": 1}), ("PassJoin", {"delta": 1})])
def test_records_too_large_to_expand_are_found_without_expansion(data, name, params):
    few, whole = (pairs(registry.run(name, spec(data, True, most=m, **params))) for m in (2, 20_000_000))
    assert few == whole
    assert whole
