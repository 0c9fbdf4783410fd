"""Exact operations on one record and its applicable rules, as plain functions without shared state.

A record is a tuple of tokens; its rules are (start, n, rhs): the n tokens from start may become rhs. Rules do not apply to what rules
have made. The set E(s) holds every sequence that a segmentation of the record into rules gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

Rule = tuple[int, int, tuple[str, ...]]


def by_end(rules: Iterable[Rule], n: int) -> list[list[Rule]]:
    out: list[list[Rule]] = [[] for _ in range(n + 1)]
    for r in rules:
        out[r[0] + r[1]].append(r)
    return out


def expand(n: int, rules: Iterable[Rule]) -> set[tuple[str, ...]]:
    """E(s) of a record of n tokens; equal prefixes are kept once."""
    reach: list[set] = [{()}]
    for at in by_end(rules, n)[1:]:
        reach.append({p + r[2] for r in at for p in reach[r[0]]})
    return reach[n]


def length_range(n: int, rules: Iterable[Rule]) -> list[tuple[int, int]]:
    """Least and greatest length of each prefix's rewritings."""
    out = [(0, 0)]
    for at in by_end(rules, n)[1:]:
        out.append((min(out[r[0]][0] + len(r[2]) for r in at), max(out[r[0]][1] + len(r[2]) for r in at)))
    return out


def count_segmentations(n: int, rules: Iterable[Rule]) -> int:
    out = [1]
    for at in by_end(rules, n)[1:]:
        out.append(sum(out[r[0]] for r in at))
    return out[n]


def reaches(n: int, rules: Iterable[Rule], y: tuple[str, ...]) -> bool:
    """y in E(s): the lengths of y's prefixes that prefixes of s can become."""
    reach = [{0}]
    for at in by_end(rules, n)[1:]:
        reach.append({j + len(r[2]) for r in at for j in reach[r[0]] if y[j : j + len(r[2])] == r[2]})
    return len(y) in reach[n]


def both_reach(n1: int, rules1: Iterable[Rule], n2: int, rules2: Iterable[Rule]) -> bool:
    """E(x) and E(y) have a sequence in common: a search over (i, j, tokens that one side is ahead)."""
    start1: dict[int, list] = {}
    start2: dict[int, list] = {}
    for s, rules in ((start1, rules1), (start2, rules2)):
        for r in rules:
            s.setdefault(r[0], []).append(r)
    seen, todo = set(), [(0, 0, (), 0)]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        i, j, rest, side = state  # side 1: rest is x's surplus, 2: y's
        if i == n1 and j == n2 and not rest:
            return True
        own, places, moved = (start2, j, 2) if side == 1 else (start1, i, 1)
        for _, k, rhs in own.get(places, ()):
            m = min(len(rest), len(rhs))
            if rest[:m] == rhs[:m]:
                left = rest[m:] or rhs[m:]
                ahead = (0 if not left else (side if len(rest) > m else moved))
                todo.append((i + k, j, left, ahead) if moved == 1 else (i, j + k, left, ahead))
    return False


def distance_step(row: list[int], token: str, y: tuple[str, ...], edit: bool) -> list[int]:
    new = [row[0] + 1]
    for j, t in enumerate(y, 1):
        best = min(row[j], new[j - 1]) + 1
        if t == token:
            best = min(best, row[j - 1])
        elif edit:
            best = min(best, row[j - 1] + 1)
        new.append(best)
    return new


def distance(x: Iterable[str], y: tuple[str, ...], edit: bool = True) -> int:
    row = list(range(len(y) + 1))
    for t in x:
        row = distance_step(row, t, y, edit)
    return row[-1]


def nearest(n: int, rules: Iterable[Rule], y: tuple[str, ...], edit: bool = True) -> int:
    """The least distance of a sequence of E(s) to y: rows of the distance table, their minimum wherever segmentations meet."""
    rows: list[list[int] | None] = [list(range(len(y) + 1))]
    for at in by_end(rules, n)[1:]:
        best = None
        for start, _, rhs in at:
            row = rows[start]
            for t in rhs:
                row = distance_step(row, t, y, edit)
            best = row if best is None else [min(a, b) for a, b in zip(best, row, strict=True)]
        rows.append(best)
    return rows[n][-1]


def set_reaches(n: int, rules: Iterable[Rule], y: tuple[str, ...]) -> bool:
    """Some sequence of E(s) has the tokens of y, as sets: the sets that prefixes can cover, with rules inside y only."""
    want = frozenset(y)
    covers = [{frozenset()}]
    for at in by_end((r for r in rules if want.issuperset(r[2])), n)[1:]:
        covers.append({c.union(r[2]) for r in at for c in covers[r[0]]})
    return want in covers[n]


def set_beam(n: int, rules: Iterable[Rule], y: tuple[str, ...], width: int = 2) -> bool:
    """As set_reaches, but of each prefix only the `width` covers that miss least stay (ties: sorted tokens). Approximate."""
    want = frozenset(y)
    covers: list[list[frozenset]] = [[frozenset()]]
    for at in by_end((r for r in rules if want.issuperset(r[2])), n)[1:]:
        found = {c.union(r[2]) for r in at for c in covers[r[0]]}
        covers.append(sorted(found, key=lambda c: (-len(c), sorted(c)))[:width])
    return want in covers[n]


def greedy_choice(n: int, rules: Iterable[Rule], y: tuple[str, ...], stop_at_zero: bool = False) -> list[Rule]:
    """Rules over disjoint segments, one after another the one of which the largest part is still wanted (not yet covered tokens of
    y); ties: start, number of tokens, rhs. With stop_at_zero only rules of a positive part are taken, and self rules not at all."""
    wanted, free, out = set(y), [True] * n, []
    left = sorted(set(rules), key=lambda r: (r[0], r[1], r[2]))
    while True:
        open_rules = [r for r in left if all(free[r[0] : r[0] + r[1]])]
        if not open_rules:
            return sorted(out)
        score = lambda r: sum(t in wanted for t in r[2]) / max(1, len(r[2]))
        best = max(open_rules, key=lambda r: (score(r), -r[0], -r[1], tuple(-ord(c) for c in " ".join(r[2]))))
        if stop_at_zero and score(best) == 0:
            return sorted(out)
        out.append(best)
        wanted.difference_update(best[2])
        free[best[0] : best[0] + best[1]] = [False] * best[1]
        left = open_rules


def greedy_sequence(n: int, rules: Iterable[Rule], y: tuple[str, ...]) -> bool:
    chosen = greedy_choice(n, rules, y)
    return sum(r[1] for r in chosen) == n and tuple(t for r in chosen for t in r[2]) == y


def greedy_set(n: int, rules: Iterable[Rule], y: tuple[str, ...]) -> bool:
    chosen = greedy_choice(n, rules, y)
    return sum(r[1] for r in chosen) == n and {t for r in chosen for t in r[2]} == set(y)


def greedy_jaccard(toks: tuple[str, ...], rules: Iterable[Rule], y: tuple[str, ...]) -> float:
    """Jaccard similarity of y and of the record after the greedy rules; what no rule covers stays."""
    chosen = greedy_choice(len(toks), [r for r in rules if toks[r[0] : r[0] + r[1]] != r[2]], y, stop_at_zero=True)
    covered = {i for r in chosen for i in range(r[0], r[0] + r[1])}
    got = {t for r in chosen for t in r[2]} | {t for i, t in enumerate(toks) if i not in covered}
    want = set(y)
    return len(got & want) / len(got | want) if got | want else 1.0


def _jac(a: set | frozenset, b: set | frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def selective_expansion(x: tuple[str, ...], rules_x: Iterable[Rule], y: tuple[str, ...], rules_y: Iterable[Rule], theta: float) -> float:
    """Similarity when rules add their rhs to a record's set.

    A rule's gain is the part of its new tokens that the other side can have at all; rules below theta / (1 + theta) are left out until none
    is; then, as long as the similarity rises, the rule that raises it most is applied (ties: side, rhs).
    """
    sets = [set(x), set(y)]
    rules = [sorted({r[2] for r in rs if not s.issuperset(r[2])}) for rs, s in ((rules_x, sets[0]), (rules_y, sets[1]))]
    while True:
        full = [sets[i].union(*rules[i]) for i in (0, 1)]
        gain = lambda i, r: len((set(r) - sets[i]) & full[1 - i]) / len(set(r) - sets[i])  # noqa: E731, B023
        kept = [[r for r in rules[i] if gain(i, r) >= theta / (1 + theta)] for i in (0, 1)]
        if kept == rules:
            break
        rules = kept
    now = _jac(*sets)
    while True:
        best = max(((_jac(sets[i] | set(r), sets[1 - i]), -i, [-ord(c) for c in " ".join(r)], i, r) for i in (0, 1) for r in rules[i]), default=None)
        if best is None or best[0] <= now:
            return now
        now = best[0]
        sets[best[3]].update(best[4])


def all_set_expansions(x: tuple[str, ...], rules: Iterable[Rule]) -> set[frozenset]:
    """The record's set with the rhs of every choice of its rules added."""
    out = {frozenset(x)}
    for r in {r[2] for r in rules if not set(x).issuperset(r[2])}:
        out |= {s.union(r) for s in out}
    return out


def best_set_expansion(x, rules_x, y, rules_y) -> float:
    return max(_jac(a, b) for a in all_set_expansions(x, rules_x) for b in all_set_expansions(y, rules_y))


def least_tokens(n: int, rules: Iterable[Rule], rank: Callable[[str], int]) -> set[int]:
    """The ranks that are the least of some sequence of E(s)."""
    low: list[set[int]] = [{1 << 62}]
    for at in by_end(rules, n)[1:]:
        low.append({min(m, min(map(rank, r[2]), default=1 << 62)) for r in at for m in low[r[0]]})
    return low[n]


def in_prefix(n: int, rules: Iterable[Rule], rank: Callable[[str], int], u: str, size: int) -> bool:
    """Is u among the `size` least tokens of some sequence of E(s)? The fewest smaller tokens before, with u met or not."""
    far = 1 << 62
    state = [(0, far)]  # (without u, with u)
    for at in by_end(rules, n)[1:]:
        best = (far, far)
        for start, _, rhs in at:
            smaller = sum(rank(t) < rank(u) for t in rhs)
            no, yes = state[start]
            yes = min(yes, no) if u in rhs else yes
            best = (min(best[0], no + smaller), min(best[1], yes + smaller if yes < far else far))
        state.append(best)
    return state[n][1] < size


def grams(n: int, rules: Iterable[Rule], q: int, pad: str, limit: int | None = None) -> set[tuple[int, int, tuple[str, ...]]]:
    """(least position, greatest position, gram): a superset of the positional q-grams of E(s), from chains of rules.

    A gram that begins at offset i of a rule's rhs stands at all positions from the least to the greatest length before the rule, plus i.
    """
    start: dict[int, list] = {}
    rules = list(rules)
    for r in rules:
        start.setdefault(r[0], []).append(r)
    lengths = length_range(n, rules)

    @lru_cache(None)
    def heads(at: int, k: int) -> frozenset:
        """First k tokens, padded, of what the record from a place on can become."""
        if k == 0:
            return frozenset({()})
        if at == n:
            return frozenset({(pad,) * k})
        return frozenset(r[2][:k] + h for r in start.get(at, ()) for h in heads(at + r[1], k - min(k, len(r[2]))))

    out = set()
    for s, m, rhs in rules:
        low, high = lengths[s]
        for i in range(len(rhs)):
            if limit is None or low + i < limit:
                head = rhs[i : i + q]
                top = high + i if limit is None else min(high + i, limit - 1)
                out |= {(low + i, top, head + h) for h in heads(s + m, q - len(head))}
    return out


def delta_variants(gram: tuple[str, ...], q: int, pad: str) -> set[tuple[tuple[str, ...], int]]:
    """(variant, delta): q of the gram's tokens; delta is the last place - q + 1. Not those that begin with a pad or skip one."""
    from itertools import combinations

    out = set()
    for c in combinations(range(len(gram)), q):
        skipped = [i for i in range(c[-1]) if i not in c]
        if gram[c[0]] != pad and not any(gram[i] == pad for i in skipped):
            out.add((tuple(gram[i] for i in c), c[-1] - q + 1))
    return out
