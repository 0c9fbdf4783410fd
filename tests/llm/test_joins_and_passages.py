"""Near duplicates, repeated passages, benchmark leaks."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from training_rows import frame, words
from lexweave.llm import decontaminate, jaccard_join, near_dedup, suffix_dedup
from lexweave.llm.components import connected_components


def sets_of(rows, k):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components(sets, percent):
    inverted, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    for at in inverted.values():
        shared.update((a, b) for n, b in enumerate(at) for a in at[:n])
    parent = list(range(len(sets)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def near_rows(seed=1):
    """Exact copies, near copies of several strengths, a chain, and a passage that many share."""
    rng = random.Random(seed)
    passage, out = words(rng, 45), []
    for _ in range(25):
        w = words(rng, rng.randint(5, 160)).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = f"e{rng.random()}"
            out.append(" ".join(v) + (" " + passage if rng.random() < 0.4 else ""))
    chain = words(rng, 120).split()
    for k in range(12):
        chain[10 * k % 120] = f"c{k}"
        out.append(" ".join(chain))
    out += [out[0], out[0].upper(), out[-1]]
    return [(i, t, "en", "a") for i, t in enumerate(out)]


SPECS = [jaccard_join.Spec(), jaccard_join.Spec(k=5, percent=80), jaccard_join.Spec(k=1, percent=70, small=2, block=4, local_hot=1), jaccard_join.Spec(hot_share=0.05, small=3, block=8, local_hot=2)]


@pytest.mark.parametrize("spec", SPECS)
def test_components_equal_brute_force(spark, rows, spec):
    data = near_rows() + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in rows]
    sets = sets_of(data, spec.k)
    root = components(sets, spec.percent)
    least = defaultdict(list)
    for r, c in zip(data, root, strict=True):
        least[c].append(r[0])
    want = Counter((r[0], len(s), (min((x for x in least[c] if x is not None), default=None) if s else r[0])) for r, s, c in zip(data, sets, root, strict=True))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, data).repartition(3), spec).collect())
    assert got == want


def test_no_allocation_loses_a_pair():
    rng = np.random.default_rng(0)
    for percent in (70, 80, 90):
        spec = jaccard_join.Spec(percent=percent)
        for counts in ({}, {k: 10**9 for k in range(12)}):
            bands = jaccard_join.make_bands(spec, counts, 400)
            for hot_part in (0.0, 0.3, 0.7, 1.0):
                for _ in range(60):
                    n = int(rng.integers(1, 120))
                    base = rng.integers(1, 2**63, n, dtype=np.uint64)
                    keep = base[rng.random(n) > rng.random() * 0.25]
                    other = np.concatenate([keep, rng.integers(1, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)])
                    a, b = np.unique(base), np.unique(other)
                    if not len(b) or not spec.linked(len(np.intersect1d(a, b)), len(a), len(b)) or np.array_equal(a, b):
                        continue
                    hot = base[rng.random(n) < hot_part]
                    signer = jaccard_join.Signer(spec, bands, hot)
                    assert np.intersect1d(signer.of(a), signer.of(b)).size


def test_empty_segments_with_neighbourhoods_take_two_units():
    spec, plan = jaccard_join.Spec(k=5, percent=80), (5, 2, 2)
    bands = [jaccard_join.Band(14, 17, 4, 8, (plan, plan)), jaccard_join.Band(18, 22, 5, 10, ((6, 0, 0), (6, 0, 0)))]
    some = np.random.default_rng(3).integers(1, 2**63, 400, dtype=np.uint64)
    seg = jaccard_join.mix64(some ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(5)
    of = [some[seg == i] for i in range(5)]
    a = np.sort(np.concatenate([of[2][:6], of[3][:5], of[4][:5]]))
    b = np.sort(np.concatenate([a, of[0][:1], of[2][6:7], of[3][5:6], of[4][5:6]]))
    assert spec.linked(len(np.intersect1d(a, b)), len(a), len(b))
    signer = jaccard_join.Signer(spec, bands, np.zeros(0, np.uint64))
    assert np.intersect1d(signer.of(a), signer.of(b)).size


def test_near_duplicates_keep_one(spark, rows, nothing):
    assert near_dedup.dedup(nothing).collect() == []
    assert jaccard_join.query(nothing).collect() == []
    data = near_rows(2) + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in rows]
    d = frame(spark, data).repartition(3)
    kept = near_dedup.dedup(d)
    assert kept.columns == d.columns
    sets, got = sets_of(data, 5), kept.select("doc_id", "text").collect()
    root = components(sets, 80)
    groups = defaultdict(list)
    for r, s, c in zip(data, sets, root, strict=True):
        if s:
            groups[c].append(r)
    texts = Counter(r.text for r in got)
    assert len(got) == len(groups) + sum(not s for s in sets)
    for members in groups.values():
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        assert any(r.doc_id == first[0] and any(r.text == m[1] for m in members if m[0] == first[0]) for r in got)
    assert sum(texts.values()) == len(got)


def test_components_of_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    touched = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in touched}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def removed(rows, length):
    count, out = Counter(), []
    raw = [(r[1] or "").encode() for r in rows]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for r, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 150])
def test_repeats_equal_brute_force(spark, rows, nothing, length):
    assert suffix_dedup.query(nothing).collect() == []
    rng = random.Random(8)
    base = [words(rng, 120) for _ in range(12)]
    data = list(rows) + [(500 + i, words(rng, 30) + base[i % 4][i : i + 199 + i % 3] + "é" * (i % 5) + base[(i + 1) % 12][50 : 50 + 40 * i] + words(rng, 9), "en", "a") for i in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, data).repartition(5), length).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(removed(data, length))


def test_difference_sets():
    for q in (2, 3, 5, 7, 11):
        v, places = suffix_dedup.difference_set(q)
        assert len(places) == q + 1 and {(a - b) % v for a in places for b in places} == set(range(v))


def test_cut_passages_leave_whole_characters(spark, nothing):
    assert suffix_dedup.dedup(nothing).collect() == []
    shared = "日本語テキスト" * 12
    data = [(1, "á" + shared + "z", "ja", "a"), (1, "b" + shared + "é", "ja", "b"), (None, shared, None, None), (4, None, "x", None), (5, "short", "en", "a")]
    d = frame(spark, data)
    out = suffix_dedup.dedup(d)
    assert out.columns == d.columns and out.schema["text"].dataType == d.schema["text"].dataType
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert got == Counter([(1, "áz", 2), (1, "bé", 2), (None, "", 0), (4, None, None), (5, "short", 5)])


def leaks(docs, items, least=0.8, k=5):
    runs = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    out = set()
    for n, r in enumerate(docs):
        w = (r[1] or "").encode().lower().split()
        for item, text in items:
            v = (text or "").encode().lower().split()
            if not v or not w:
                continue
            want = runs(v)
            for i in range(max(1, len(w) - len(v) + 1)):
                have = runs(w[i : i + len(v)])
                low = sum((want & have).values())
                if low / (sum(want.values()) + sum(have.values()) - low) >= least:
                    out.add((n, r[0], item))
                    break
    return out


def test_leaks_equal_brute_force(spark, nothing):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(15, 60), 5000)) for i in range(25)] + [(25, None), (26, ""), (27, "tiny item here")]
    items.append((28, items[3][1]))
    docs = []
    for i in range(120):
        w = words(rng, rng.randint(0, 150), 5000).split()
        if i % 3 == 0:
            v = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = v[rng.randint(0, 2) :]
        docs.append((i, " ".join(w).title() if i % 2 else " ".join(w), "en", "a"))
    docs += [(200, items[2][1], "en", "a"), (200, items[2][1], "en", "a"), (None, items[4][1] + " z", None, None), (201, None, None, None), (202, "so TINY item here is", "en", "a"), (203, "tiny", "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = frame(spark, docs).repartition(3)
    got = decontaminate.query(d, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter((doc, item) for _, doc, item in leaks(docs, items))
    again = decontaminate.find_leaks(d, bench, block_words=60).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert decontaminate.query(nothing, bench).collect() == [] == decontaminate.query(d, bench.limit(0)).collect()
    bad = {n for n, *_ in leaks(docs, items)}
    kept = decontaminate.drop_leaks(d, bench)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r[:2] for n, r in enumerate(docs) if n not in bad)
