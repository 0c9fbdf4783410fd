import random
from itertools import combinations

import pytest

from lexweave.functions import rewriting as R

PAD = "$"


def rules_for(toks, rules):
    """Applicable (start, n, rhs), with the identity of each token."""
    out = {(i, 1, (t,)) for i, t in enumerate(toks)}
    for lhs, rhs in rules:
        out |= {(i, len(lhs), tuple(rhs)) for i in range(len(toks) - len(lhs) + 1) if tuple(toks[i : i + len(lhs)]) == tuple(lhs)}
    return sorted(out)


def brute(toks, rules, at=0):
    if at == len(toks):
        return {()}
    return {r[2] + rest for r in rules if r[0] == at for rest in brute(toks, rules, at + r[1])}


def case(rng, alphabet="abcd", longest=5):
    some = lambda low, high: tuple(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    toks = some(1, longest)
    return toks, rules_for(toks, [(some(1, 2), some(1, 2)) for _ in range(rng.randint(0, 3))]), some(1, longest)


def test_expansion_fixture():
    toks = ("1", "2", "3", "4")
    rules = rules_for(toks, [(("1", "2", "3"), ("10", "11")), (("2", "3"), ("12", "13", "14")), (("4",), ("15", "16", "17"))])
    assert len(R.expand(4, rules)) == 6 == R.count_segmentations(4, rules)
    assert R.length_range(4, rules)[-1] == (3, 7)
    for q, want in {2: [3, 4, 5, 5, 4, 2, 1], 3: [4, 5, 6, 5, 4, 2, 1], 4: [5, 6, 6, 5, 4, 2, 1]}.items():
        at = {}
        for low, high, g in R.grams(4, rules, q, PAD):
            for p in range(low, high + 1):
                at.setdefault(p, set()).add(g)
        assert [len(at[p]) for p in range(7)] == want


@pytest.mark.parametrize(
    ("x", "y", "want"),
    [("1 1 1 1 1", "1 1 1 1 1", 0), ("1 2 3 4 5", "1 2 3 4 5", 0), ("1 2 3 4 5", "5 4 3 2 1", 4), ("5 4 1 2 3", "5 4 3 2 1", 2), ("3 4 5 2 1", "5 4 3 2 1", 2), ("1 2 3 4 5 5 5 5 5 5", "1 2 3 4 5", 5), ("1 1 1 1 1 1 2 3 4 5", "1 2 3 4 5", 5)],
)
def test_edit_table(x, y, want):
    assert R.distance(x.split(), tuple(y.split())) == want


def test_planted_common_subsequence():
    rng, fresh = random.Random(0), iter(range(10**9))
    for _ in range(1000):
        z = [str(rng.randrange(10)) for _ in range(rng.randint(0, 10))]
        sides = []
        for _ in range(2):
            s = list(z)
            for _ in range(rng.randint(0, 8)):
                s.insert(rng.randint(0, len(s)), f"-{next(fresh)}")
            sides.append(s)
        assert (len(sides[0]) + len(sides[1]) - R.distance(sides[0], tuple(sides[1]), edit=False)) // 2 == len(z)


def test_delta_variants_of_five():
    want = {"ABC": 0, "ABD": 1, "ABE": 2, "ACD": 1, "ACE": 2, "ADE": 2, "BCD": 1, "BCE": 2, "BDE": 2, "CDE": 2}
    assert {("".join(g), d) for g, d in R.delta_variants(tuple("ABCDE"), 3, PAD)} == set(want.items())
    assert R.delta_variants(("a", PAD, PAD), 2, PAD) == {(("a", PAD), 0)}


def test_random_cases_agree_with_enumeration():
    rng = random.Random(1)
    for _ in range(1500):
        toks, rules, y = case(rng)
        n, made = len(toks), brute(toks, rules)
        assert R.expand(n, rules) == made
        assert R.length_range(n, rules)[-1] == (min(map(len, made)), max(map(len, made)))
        assert R.reaches(n, rules, y) == (y in made)
        assert R.set_reaches(n, rules, y) == any(set(e) == set(y) for e in made)
        for edit in (True, False):
            assert R.nearest(n, rules, y, edit) == min(R.distance(e, y, edit) for e in made)
        ry = case(rng)
        assert R.both_reach(n, rules, len(ry[0]), ry[1]) == (not made.isdisjoint(brute(ry[0], ry[1])))
        # approximate verifiers never accept what is not so
        assert not R.greedy_sequence(n, rules, y) or y in made
        assert not R.greedy_set(n, rules, y) or R.set_reaches(n, rules, y)
        assert not R.set_beam(n, rules, y, 2) or R.set_reaches(n, rules, y)


def test_prefix_membership():
    rng = random.Random(2)
    for _ in range(800):
        toks, rules, _ = case(rng)
        made, rank = brute(toks, rules), "dbac".index
        for size in (1, 2, 3):
            for u in "abcd":
                want = any(u in e and sum(rank(t) < rank(u) for t in e) < size for e in made)
                assert R.in_prefix(len(toks), rules, rank, u, size) == want
        assert R.least_tokens(len(toks), rules, rank) == {min(map(rank, e)) for e in made}


def test_grams_hold_all_of_the_rewritings():
    rng = random.Random(3)
    for _ in range(400):
        toks, rules, _ = case(rng)
        for q in (1, 2, 3):
            wide = {(p, g) for low, high, g in R.grams(len(toks), rules, q, PAD) for p in range(low, high + 1)}
            for e in brute(toks, rules):
                padded = e + (PAD,) * (q - 1)
                assert {(i, padded[i : i + q]) for i in range(len(e))} <= wide


def test_selective_expansion_is_bounded_by_the_best():
    rng = random.Random(4)
    for _ in range(300):
        x, rx, _ = case(rng)
        y, ry, _ = case(rng)
        got = R.selective_expansion(x, rx, y, ry, 0.5)
        assert R._jac(set(x), set(y)) <= got <= R.best_set_expansion(x, rx, y, ry) + 1e-12


def test_combinations():
    from lexweave.functions.arrays import choose, choose_by_size, choose_up_to

    assert choose(4, 2) == list(combinations(range(4), 2))
    assert len(choose_up_to(4, 2)) == 11 and {k: len(v) for k, v in choose_by_size(4, 2).items()} == {0: 1, 1: 4, 2: 6}
