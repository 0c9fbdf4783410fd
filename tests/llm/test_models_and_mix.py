"""Source mix, language model, toxicity, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from training_rows import frame, words
from lexweave.llm import lm_score, mixing, toxicity

tokens = lambda t: (t or "").encode().lower().split()


def fill(sizes, max_epochs=3):
    """Targets by rounds, as the contract tells them."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > max_epochs * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(max_epochs * sizes[s]) for s in over}


def test_mix(docs, rows, nothing):
    assert mixing.query(nothing).collect() == []
    got = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(tokens(t))
    want, taken = fill(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    order = lambda x: sorted(map(str, x))
    assert order(mixing.query(docs.repartition(7)).collect()) == order(mixing.query(docs).collect())
    whole = mixing.mixed(docs)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.count() == sum(r.taken > 0 for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_water_level(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice([f"s{i}", f"é{i}"]): rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 10**6)]) for i in range(rng.randint(1, 12))}
    if seed % 2:
        sizes[None] = 5
    t = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for r in mixing.source_targets(t).collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)


def test_mix_against_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    documents = docs.toPandas()[["doc_id", "text", "source"]]
    con.register("raw", documents)
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM raw")
    want = con.sql(mixing.SQL).fetchall()
    cols = [c[0] for c in con.sql(mixing.SQL).description]
    got = mixing.query(docs).select(*cols).collect()
    show = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    assert Counter(map(show, map(tuple, got))) == Counter(map(show, want))


def test_language_model(docs, rows, nothing):
    assert lm_score.query(nothing).collect() == []
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter()
    for d, t, *_ in rows:
        if not held(d):
            c.update([*tokens(t), "end"])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, t, *_ in rows:
        w = [*tokens(t), "end"]
        want[d].append((held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    whole, asked = (lm_score.score_texts(docs, max_filter_bytes=b).collect() for b in (256 << 20, 0))
    for found in (whole, asked):
        got = defaultdict(list)
        for r in found:
            got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        for d, xs in want.items():
            for a, b in zip(sorted(xs), sorted(got[d]), strict=True):
                assert a[:4] == b[:4] and math.isclose(a[4], b[4], abs_tol=1e-6)
    order = lambda x: sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in x))
    assert order(whole) == order(asked)
    assert sum(r.score for r in whole) > sum(r.base_score for r in whole)


def test_filter_never_counts_too_low():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    counts = rng.integers(1, 300, 5000)
    f = lm_score.Filter(1)
    bits, size = f.build(keys, counts)
    at = np.zeros(len(keys), np.int64), np.full(len(keys), size, np.uint64)
    level = f.levels(keys, bits, *at)
    true = np.floor(np.log2(counts)) + 1
    assert (level >= true).all() and (level > true).mean() < 0.12
    absent = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    assert (f.levels(absent, bits, *at) > 0).mean() < 0.1


def test_counts_beyond_32_bits_are_told_whole(spark):
    import numpy as np

    rows = [(0, 5, 8, np.array([7, 9], ">u8").tobytes(), np.array([2**32 - 1, 3], np.uint32).tobytes()), (0, 6, 8, np.array([7], ">u8").tobytes(), np.array([2**32 - 1], np.uint32).tobytes())]
    told = lm_score.gather(spark.createDataFrame(rows, lm_score.COUNTED), lm_score.Filter(1), False).filter("chunk IS NOT NULL")
    got = {r["chunk"]: (r["kind"], np.frombuffer(r["blob"], np.uint64).tolist()) for r in told.collect()}
    assert got == {5: (4, [2**33 - 2, 3]), 6: (4, [2**33 - 2])}


def labelled(spark, n=400, seed=2):
    rng, data, labels = random.Random(seed), [], []
    for i in range(n):
        w, bad = words(rng, rng.randint(20, 200)).split(), rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["Wretchling", "foulmouth", f"grubby{rng.choice('abcde')}x"]))
        data.append((i, " ".join(w), "en", "a"))
        labels.append((i, 1, int(bad)))
    return frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark, docs, rows, nothing):
    d, table, labels = labelled(spark)
    out = {r.doc_id: r for r in toxicity.query(d, table).collect()}
    held = [(i, y) for i, _, y in labels if out[i].held_out]
    assert len(held) > 80
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted for i, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(out[i].predicted for i, y in held if not y) <= 0.02 * sum(not y for _, y in held)
    odd = toxicity.query(docs, table.limit(0)).collect()
    assert len(odd) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in odd)
    assert toxicity.query(nothing, table).collect() == []
    scorer = toxicity.train(d, table)
    got = toxicity.score_texts(docs, scorer).collect()
    assert len(got) == len(rows) and all(r.score < 0.7 for r in got if r.doc_id in (100, 101))
    kept = toxicity.drop_toxic(d, table)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    # labels of held-out rows are not read
    flipped = table.selectExpr("doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert {r.doc_id: r.score for r in toxicity.query(d, flipped).collect()} == {i: r.score for i, r in out.items()}


def test_table_finds_all_keys():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    t = toxicity.Table(keys[::2], np.arange(len(keys[::2])))
    value, there = t.find(keys)
    assert there[::2].all() and not there[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks", "source_mix"]
    d, table, labels = labelled(spark)
    rng = random.Random(9)
    item = words(rng, 40, 5000)
    passage = words(rng, 80, 5000)
    extra = [(1000, "clean " + item + " end", "en", "b"), (1001, words(rng, 90, 5000), "en", "b"), (1003, words(rng, 60, 5000) + " " + passage, "fr", None), (1004, passage + " " + words(rng, 60, 5000), "fr", None)]
    extra += [(1002, extra[1][1] + " x", "en", "b"), (1005, None, None, None), (None, "", "en", "b")]
    docs = d.select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, extra, clash=False))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "source_mix":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect()}
    toxic = {i for i, _, y in labels if y}
    assert not toxic & set(kept["toxicity"]) or len(toxic & set(kept["toxicity"])) <= 0.05 * len(toxic)
    assert set(range(400)) - toxic <= set(kept["toxicity"]) and {1000, 1001, 1002, 1003, 1004, 1005, None} <= set(kept["toxicity"])
    assert 1002 not in kept["near_duplicates"] and {1000, 1001, 1003, 1004} <= set(kept["near_duplicates"])
    assert passage[:150] not in kept["repeated_passages"][1003].text and kept["repeated_passages"][1003].n_chars == len(kept["repeated_passages"][1003].text)
    assert kept["repeated_passages"][1001].text == extra[1][1]
    assert set(kept["repeated_passages"]) - set(kept["benchmark_leaks"]) == {1000}
    assert all(r.taken > 0 for r in kept["source_mix"].values())
    assert p.run(spark, str(tmp_path)).count() == len(kept["source_mix"])


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_jaccard_join", "op3_mix_sources"])
def test_queries_against_sql(spark, tmp_path, rows, name):
    import duckdb

    from lexweave.llm import queries

    seen, unique = set(), []
    for r in rows:  # ids are keys where the SQL groups by them
        if r[0] is not None and r[0] not in seen and "\x00" not in (r[1] or ""):
            seen.add(r[0])
            unique.append(r)
    frame(spark, unique, clash=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(map(show, map(tuple, got))) == Counter(map(show, want.fetchall()))
