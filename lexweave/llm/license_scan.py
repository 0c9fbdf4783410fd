"""License scan by a positional index of rare tokens.

Templates are phrases of licence texts, as words. IDFs of the templates' words are counted over all documents. Every word of a
template is posted with its position. A file's licence words are looked up from the highest IDF down: the first that a template
has proposes starts (place in the file - position in the template), and the proposals of the template's other words, in the same order, are
intersected with them by relative position until none is left or all words agree. A label of several mandatory phrases is given if
all of them occur. The three base phrases are templates of their own, so their places come from the same index.

Defined cases: null text is empty; a file without words has no labels and score 0; equal places of several phrases count once each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Label: base phrase.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label: key phrases, all mandatory.
LABELS = {
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "apache-notice": ("you may not use this file except in compliance with the license",),
    "bsd": ("redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"),
    "gpl-notice": ("free software you can redistribute it and or modify it", "under the terms of the gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "lgpl": ("gnu lesser general public license",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "mpl": ("mozilla public license",),
    "no-warranty": ("without warranty of any kind",),
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Index:
    """Licence words to (template, position)."""

    def __init__(self, df: dict[bytes, int], n_docs: int, base: dict[str, str] = BASE, labels: dict[str, tuple[str, ...]] = LABELS):
        self.base, self.labels = base, labels
        self.phrases = sorted({*base.values(), *(p for ps in labels.values() for p in ps)})
        words = [p.encode().split() for p in self.phrases]
        idf = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 1))) for ws in words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = {w: [] for w in sorted(idf, key=lambda w: (-idf[w], w))}  # highest IDF first
        for i, ws in enumerate(words):
            for k, w in enumerate(ws):
                self.postings[w].append((i, k))
        rank = {w: r for r, w in enumerate(self.postings)}
        self.order = [sorted(((k, w) for k, w in enumerate(ws)), key=lambda x: (rank[x[1]], x[0])) for ws in words]
        self.weight = [sum(idf[w] for w in ws) for ws in words]

    def places(self, words: list[bytes]) -> dict[int, list[int]]:
        """Template to the starts of its occurrences."""
        at: dict[bytes, list[int]] = {}
        for place, w in enumerate(words):
            if w in self.postings:
                at.setdefault(w, []).append(place)
        out: dict[int, list[int]] = {}
        for w in self.postings.keys() if at else ():
            for i, k in self.postings[w] if w in at else ():
                order = self.order[i]
                if order[0] != (k, w) or any(x not in at for _, x in order):
                    continue  # its rarest word proposes; a template with a word that the file lacks is not there
                starts = {p - k for p in at[w]}
                for j, x in order[1:]:
                    if not starts:
                        break
                    starts.intersection_update(p - j for p in at[x])
                if starts:
                    out[i] = sorted(starts)
        return out

    def scan(self, words: list[bytes]) -> tuple:
        found = self.places(words)
        at = {self.phrases[i]: p for i, p in found.items()}
        starts = [x for p in self.base.values() for x in at.get(p, ())]
        based = sorted(k for k, p in self.base.items() if p in at)
        more = [k for k, ps in self.labels.items() if all(p in at for p in ps)]
        names = sorted({*based, *more})
        weight = sum(self.weight[i] for i in found)
        score = 0.0 if not names else 1 - 1 / (1 + max(weight, 0.0))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(based), ",".join(names), score


def template_words(base: dict[str, str] = BASE, labels: dict[str, tuple[str, ...]] = LABELS) -> set[bytes]:
    return {w for p in [*base.values(), *(p for ps in labels.values() for p in ps)] for w in p.encode().split()}


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, over all documents; a row a word and task is all that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = dict.fromkeys(vocabulary, 0), 0
        finders = {w: re.compile(rb"(?<![0-9a-z\x80-\xff])" + re.escape(w) + rb"(?![0-9a-z\x80-\xff])") for w in vocabulary}
        for b in batches:
            for x in b.column(0):
                text, total = x.as_py().lower(), total + 1
                for w in vocabulary.intersection(WORD.findall(text)) if len(text) < 1 << 26 else [w for w, f in finders.items() if f.search(text)]:
                    n[w] += 1
        words = [*n, b""]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*n.values(), total], pa.int64())], ["word", "n"])

    d = docs.select(utf8("text").alias("b")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {bytes(r["word"]): int(r["n"]) for r in d.collect()}
    return got, got.pop(b"", 0)


def scan(docs: DataFrame, base: dict[str, str] = BASE, labels: dict[str, tuple[str, ...]] = LABELS) -> DataFrame:
    df, n = document_frequencies(docs, template_words(base, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, base, labels)
        for b in batches:
            got = [index.scan(WORD.findall(x.as_py().lower())) for x in b.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("b")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle(base: dict[str, str] = BASE, labels: dict[str, tuple[str, ...]] = LABELS) -> str:
    """The same rows in SQL, by looking for every phrase at every word."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = sorted({*base.values(), *(p for ps in labels.values() for p in ps)})
    rows = ", ".join(f"({text(p)})" for p in phrases)
    named = ", ".join(f"({text(k)}, {text(p)}, true)" for k, p in base.items()) + ", " + ", ".join(f"({text(k)}, {text(p)}, false)" for k, ps in labels.items() for p in ps)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT p, string_split(p, ' ') AS ws FROM (VALUES {rows}) AS v(p)),
named AS (SELECT * FROM (VALUES {named}) AS v(label, p, is_base)),
total AS (SELECT count(*) AS n FROM words),
vocabulary AS (SELECT DISTINCT unnest(ws) AS word FROM phrases),
df AS (SELECT v.word, count(w.r) AS n FROM vocabulary v LEFT JOIN words w ON list_contains(w.w, v.word) GROUP BY v.word),
weights AS (SELECT p, sum(ln((total.n + 1) / (df.n + 1))) AS weight FROM (SELECT p, unnest(ws) AS word FROM phrases) JOIN df USING (word), total GROUP BY p),
places AS (
  SELECT r, p, unnest(list_filter(range(0, len(w) - len(ws) + 1), lambda i: w[i + 1:i + len(ws)] = ws)) AS at_word
  FROM words, phrases WHERE list_contains(w, ws[1]) AND len(w) >= len(ws)),
found AS (SELECT DISTINCT r, p FROM places),
held AS (SELECT r, label, is_base FROM named LEFT JOIN found USING (p) GROUP BY r, label, is_base HAVING r IS NOT NULL AND count(*) = (SELECT count(*) FROM named x WHERE x.label = named.label AND x.is_base = named.is_base)),
names AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels FROM held GROUP BY r),
spots AS (SELECT r, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word FROM places JOIN named USING (p) WHERE is_base GROUP BY r),
heavy AS (SELECT r, sum(weight) AS weight FROM found JOIN weights USING (p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN labels IS NULL THEN 0.0 ELSE 1 - 1 / (1 + greatest(weight, 0.0)) END AS score
FROM words LEFT JOIN names USING (r) LEFT JOIN spots USING (r) LEFT JOIN heavy USING (r)
"""
