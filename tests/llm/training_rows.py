"""Rows for the tests of this folder."""

import random

CLASH = {"b": "clash", "text_": "t", "n": 1, "node": 2, "group": 3, "score": 0.5, "size": 7, "row": 8, "part": "p", "u": "u", "taken": 9, "target": 1.0, "held_out": True, "chunk": 4, "kept": "k", "label": None}


def words(rng, n, kinds=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % kinds}" for _ in range(n))


def edge_rows(seed=5):
    """(doc_id, text, lang, source): nulls anywhere, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 300)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(base)]
    rows += [(None, None, None, None), (None, base[3], "en", "a"), (100, "", "en", ""), (101, " \t\n ", None, "b"), (102, "one", "fr", "c"), (103, "one two", "fr", None)]
    rows += [(104, base[5], "en", "a"), (104, base[5], "en", "a"), (104, base[6], "en", "b"), (105, base[5] + " x", "en", "a")]
    rows += [(106, "Ünï cödé 日本語 😀   ÀÉ" * 30, "de", "é"), (107, "a\x00b\x01 MIT LICENSE mit\tlicense", "en", "a"), (108, words(rng, 40_000), "en", "c"), (109, "ab" * 30_000, None, "a")]
    rows += [(110, base[7][:50] + base[8], "en", "a"), (111, "Under the Apache License. General Public License, mit license", "en", "b")]
    return rows


def frame(spark, rows, clash=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(data, schema)
    if clash:
        from pyspark.sql import functions as F

        for k, v in CLASH.items():
            df = df.withColumn(k, F.lit(v) if v is not None else F.lit(None).cast("string"))
    return df
