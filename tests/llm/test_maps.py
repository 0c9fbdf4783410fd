"""Licences, tokens, media, languages."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import language_id, license_scan, media, token_counts
from lexweave.llm.common import fold


def by_text(rows):
    return sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)


def test_license_scan(docs, rows, nothing):
    assert license_scan.query(nothing).collect() == []
    got = license_scan.query(docs).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, i) for k, p in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for _, i in at]
        want.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({k for k, _ in at}))))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_labels_need_all_phrases(spark):
    a, b = license_scan.LABELS["bsd"]
    d = spark.createDataFrame([(1, a), (2, f"{a} ... {b}"), (3, b)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.query(d).collect()} == {1: "", 2: "bsd", 3: ""}


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.load(token_counts.tokenizer_path())


def test_token_counts(docs, rows, nothing, tokenizer):
    assert token_counts.query(nothing).collect() == []
    want = [(d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t, *_ in rows]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.query(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in token_counts.query(docs).collect())


PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "ß", "12", "'s", "'", "日本", "　", "😀", "٣", "x" * 30, "́", " word", "<|endoftext|>", "!", "\x85"]), max_size=80).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_splices_equal_the_whole(text):
    import public_tokenizers

    c = test_splices_equal_the_whole.__dict__.setdefault("c", None) or token_counts.Counter(token_counts.tokenizer_path(), huge=20, chunk=12, overlap=4, ranks=(token_counts.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    test_splices_equal_the_whole.__dict__["c"] = c
    assert c.fast is not None
    assert c.count([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False))]


def test_splices_without_a_boundary(tokenizer):
    c = token_counts.Counter(token_counts.tokenizer_path(), huge=100, chunk=64, overlap=8)
    rng = random.Random(4)
    for text in ["x" * 5000, " " * 3000, "日本" * 900, "a b " * 900, "".join(rng.choice("ab 1\n") for _ in range(4000)), ("word " * 50 + "z" * 400) * 4]:
        assert c.count([text]) == [len(tokenizer.encode(text, add_special_tokens=False))]


SCRIPTS = {
    "cyrillic": lambda r: " ".join("".join(r.choice("абвгдежзиклмнопрст") for _ in range(r.randint(2, 9))) for _ in range(20_000)),
    "cjk": lambda r: "".join(chr(r.randint(0x4E00, 0x5FFF)) if r.random() > 0.05 else "。" for _ in range(60_000)),
    "arabic": lambda r: "،".join("".join(r.choice("ابتثجحخدذرزسشصض") for _ in range(r.randint(2, 30))) for _ in range(7_000)),
    "special": lambda r: "<|endoftext|>".join("word " * r.randint(0, 4_000) for _ in range(60)),
    "code": lambda r: "\n".join(f"    x_{r.randint(0, 99)} += [{r.randint(0, 9**9)}];" for _ in range(6_000)),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_stay_bounded_in_any_script(tokenizer, script):
    text = SCRIPTS[script](random.Random(3))
    c = token_counts.Counter(token_counts.tokenizer_path(), huge=1 << 14, chunk=1 << 14)
    seen, real = [], c.encode
    c.encode = lambda t: seen.append(len(t)) or real(t)
    assert c.count([text]) == [len(tokenizer.encode(text, add_special_tokens=False))]
    assert len(seen) > 2 and max(seen) < 1 << 15 and sum(seen) < 1.2 * len(text)


def test_a_stretch_without_boundary_is_one_chunk(tokenizer):
    rng = random.Random(5)
    run = "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(40_000))
    c = token_counts.Counter(token_counts.tokenizer_path(), huge=1 << 13, chunk=1 << 13)
    seen, real = [], c.encode
    c.encode = lambda t: seen.append(len(t)) or real(t)
    text = run + "。" + "word " * 9_000 + run
    assert c.count([text]) == [len(tokenizer.encode(text, add_special_tokens=False))]
    assert sum(seen) < 2 * len(text)


def test_media_round_trip(docs, rows, nothing):
    assert media.query(nothing).collect() == []
    got = media.query(docs).collect()
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_media_ranges_and_retries(docs, spark, tmp_path, monkeypatch):
    made = media.write_archives(docs.limit(20).coalesce(1), f"file://{tmp_path}/a")
    reader = media.ArchiveReader({"archives": '["' + made[0][0] + '"]', "range_bytes": "2000", "batch_bytes": "1000", "wait_s": "0"})
    parts = reader.partitions()
    assert len(parts) > 3 and sum(p.members for p in parts) == 20
    real, failed = media.ArchiveReader.member, []

    def flaky(f, at):
        if at not in failed:
            failed.append(at)
            raise OSError("lost")
        return real(f, at)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(flaky))
    names = [n for p in parts for b in reader.read(p) for n in b.column("member").to_pylist()]
    assert len(names) == len(set(names)) == 20 == len(failed)
    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(lambda f, at: (_ for _ in ()).throw(OSError("gone"))))
    with pytest.raises(OSError):
        list(reader.read(parts[0]))


def test_damaged_png_is_noticed():
    good = media.png_encode(bytes(range(64)))
    assert media.png_decode(good) == bytes(range(64))
    with pytest.raises(ValueError):
        media.png_decode(good[:45] + bytes([good[45] ^ 1]) + good[46:])


def test_language_id(spark, docs, rows, nothing):
    assert language_id.query(nothing).collect() == []
    got = language_id.query(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (100, 101)} == {"und"}
    sound = {"aa": ["tak", "rim", "sol", "ban"], "bb": ["che", "lou", "vre", "eau"]}
    rng = random.Random(1)
    data = [(i, " ".join("".join(rng.choice(sound[k]) for _ in range(rng.randint(1, 3))) for _ in range(60)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    d = spark.createDataFrame([*data, (900, "123 456", "aa"), (901, None, "bb"), (902, "tak rim sol", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.query(d).collect()}
    held = [(i, k) for i, _, k in data if out[i].held_out]
    assert len(held) > 40 and sum(out[i].lang_pred == k for i, k in held) >= 0.98 * len(held)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "aa"
    want = {r.doc_id: r.h for r in d.select("doc_id", (fold("doc_id", 3) == 1).alias("h")).collect()}
    assert all(want[i] == (zlib.crc32(str(i).encode()) % 3 == 1) == r.held_out for i, r in out.items())
    none = language_id.query(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_language_sample_counts_copies_once(spark):
    texts = [f"{'abcdefghij'[i]} tak rim sol ban {i} " + "abcdefghij"[i] * 5 for i in range(10)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) AS u").orderBy("u").first()["text"]
    d = spark.createDataFrame([(t, "aa") for t in texts + [first] * 300], "text string, lang string").repartition(4)
    plain = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    got = language_id.train_dictionaries(d, dict_docs=8, dict_bytes=8 << 8)
    assert got == language_id.train_dictionaries(plain, dict_docs=8, dict_bytes=8 << 8)
    assert sum(x * 5 in got["aa"].decode() for x in "abcdefghij") == 8
