import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import rewriting as R
from lexweave.operators import distances

DATA = Path("/root/testdata/sf0.01")


def expected(x, y):
    edit, indel = R.distance(x, tuple(y), True), R.distance(x, tuple(y), False)
    both, either = len(set(x) & set(y)), len(set(x) | set(y))
    return (len(x) + len(y) - indel) // 2, indel, edit, (2 * 10**9 * both + either) // (2 * either) / 1e9 if either else None


def measured(left, right):
    side = np.array([True] * len(left) + [False] * len(right))
    out = {}
    for b in distances.measure(side, np.array([*range(len(left)), *range(len(right))]), pa.array([*left, *right], pa.list_(pa.string()))):
        for r in b.to_pylist():
            assert (r["id1"], r["id2"]) not in out
            out[r["id1"], r["id2"]] = tuple(r[c] for c in ("lcs", "indel", "edit", "jaccard"))
    return out


@pytest.mark.parametrize("places", [1, 300, 1 << 20])
def test_blocks_equal_brute_force(monkeypatch, places):
    monkeypatch.setattr(distances, "PLACES", places)
    r = random.Random(5)
    made = lambda n, words: [r.choice(words) for _ in range(n)]
    left = [[], [""], ["a"], ["a", "a"], ["a", "b", "a"], *(made(r.randint(0, 9), "abcd") for _ in range(25)), made(70, "abc"), made(140, "abcdefgh")]
    right = [[], [""], ["b"], ["a", "b", "a"], *(made(r.randint(0, 9), "abcde") for _ in range(20)), made(33, "ab"), made(129, "abcdefgh"), [str(i) for i in range(200)]]
    assert measured(left, right) == {(i, j): expected(x, y) for i, x in enumerate(left) for j, y in enumerate(right)}


def test_jaccard_is_rounded_as_round_does(spark):
    words = [str(i) for i in range(1024)]
    got = measured([words[:1], words[:3]], [words])
    want = spark.range(1).select(*(F.round(F.lit(k) / F.lit(1024), 9) for k in (1, 3))).first()
    assert (got[0, 0][3], got[1, 0][3]) == tuple(want) == (0.000976563, 0.002929688)
    assert got[0, 0][:3] == (1, 1023, 1023)


def test_grid_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 7)
    r = random.Random(6)
    rows = [(i // 2, [r.choice("abcd") for _ in range(r.randint(0, 6))]) for i in range(60)]
    s, t = (spark.createDataFrame(x, "id long, toks array<string>") for x in (rows, rows[:15]))
    flat = lambda d: sorted(tuple(x) for x in d.na.fill(-1).collect())
    pairs = lambda a, b: sorted((i, j, *(-1 if v is None else v for v in expected(x, y))) for i, x in a for j, y in b)
    assert flat(distances.all_pairs(s, t)) == pairs(rows, rows[:15])
    assert flat(distances.all_pairs(s)) == pairs(rows, rows)
    assert distances.all_pairs(s, t.limit(0)).count() == distances.all_pairs(s.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_all_items_are_measured_in_time(spark):
    """95 s when each pair was a fold of its own, all in one task."""
    import __spark_entry__ as e

    from lexweave import queries as q

    recs = {r.id: r.toks for r in q.records(spark, str(DATA)).collect()}
    began = time.time()
    found = e.queries()["array_distances_items"](spark, str(DATA))
    some = sorted(recs)[:3]
    sums, few = found.agg(F.count("*"), *(F.sum(c) for c in ("lcs", "indel", "edit", "jaccard"))).first(), found.filter(F.col("id1").isin(some)).collect()
    assert time.time() - began < 40
    assert sums[0] == len(recs) ** 2
    assert {(r.id1, r.id2): tuple(r)[2:] for r in few} == {(i, j): expected(recs[i], recs[j]) for i in some for j in recs}
