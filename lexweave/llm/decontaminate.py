"""Benchmark decontamination by SimHash over windows of the items' own sizes.

Items and documents are words (A-Z lower-cased) and their runs of five; an item of fewer words is one run. A window of as many
words as the item has gets a 64-bit SimHash of its runs, each as often as it stands there. Fingerprints are split into
8 blocks of 8 bits; two within Hamming distance `radius` = 23 agree in some block but for 2 bits, so that for each block a table
of 256 values names all items within 2 bits, and the union over the blocks holds every item within the radius. Items of the
window's size that are so near are verified: weighted Jaccard similarity (sum of the lesser over sum of the greater
counts of runs) of `least` = 0.8 or more. Fingerprints are made only of windows that hold a run of an item of that size, as no other
window can be similar.

At similarity 0.8 the expected distance is about 10 of 64 bits with a deviation of 3, so that the radius is 4.5 deviations away.

Benchmarks of more than `block_words` words are taken in blocks, with a pass over the documents for each, so that what is broadcast is bounded.

Defined cases: null and empty texts match nothing; a document with fewer words than an item is one window; equal items are each
reported; null and repeated ids are kept (a row each); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .textops import LOWER, U64, Rolling, binary_parts, mix64, shingles, slices, word_spans

SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long, contaminated boolean"
K = 5
_BITS = np.arange(64, dtype=U64)


def signs(runs: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, a column a bit."""
    return ((mix64(runs)[:, None] >> _BITS) & U64(1)).astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U64) << _BITS).sum(-1, dtype=U64)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Runs of five of one text; of fewer words, all as one."""
    if len(words) >= K:
        return shingles(words, np.array([0, len(words)]), K)[0]
    h = np.array([len(words)], U64)
    for w in words:
        h = mix64(h * U64(0x2545F4914F6CDD1D) + w)
    return h if len(words) else np.zeros(0, U64)


def text_words(text: bytes) -> np.ndarray:
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return Rolling(data).of(starts, ends) if len(starts) else np.zeros(0, U64)


def similarity(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[x]) for x, n in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


class Index:
    """Items by size: fingerprints, block tables, runs."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = 23, least: float = 0.8):
        self.radius, self.least = radius, least
        self.ids, self.counts, self.sizes, prints, owners = [], [], [], [], {}
        for item, text in items:
            words = text_words(text)
            if not len(words):
                continue
            runs = runs_of(words)
            for r in set(runs.tolist()):
                owners.setdefault(r, set()).add(len(words))
            prints.append(simhash(signs(runs).sum(0)))
            self.ids.append(item)
            self.counts.append(Counter(runs.tolist()))
            self.sizes.append(len(words))
        self.prints, self.sizes = np.array(prints, U64), np.array(self.sizes, np.int64)
        self.runs = np.array(sorted(owners), U64)
        self.owner_sizes = [sorted(owners[int(r)]) for r in self.runs]
        self.short = sorted({n for n in self.sizes.tolist() if n < K})
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.runs & U64((1 << 22) - 1)).astype(np.int64)] = True
        near = [[v for v in range(256) if bin(v ^ x).count("1") <= radius // 8] for x in range(256)]
        self.tables = np.zeros((8, 256, -(-max(1, len(self.ids)) // 8)), np.uint8)
        for i, p in enumerate(self.prints):
            for block in range(8):
                self.tables[block, near[int(p >> U64(8 * block)) & 255], i // 8] |= 128 >> i % 8

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Places of runs that an item has."""
        if not len(self.runs) or not len(runs):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(runs & U64((1 << 22) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.runs, runs[at]), len(self.runs) - 1)
        return at[self.runs[k] == runs[at]]

    def near(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(window, item) of that size within the radius, through the blocks."""
        found = np.zeros((len(prints), self.tables.shape[2]), np.uint8)
        for block in range(8):
            found |= self.tables[block][((prints >> U64(8 * block)) & U64(255)).astype(np.int64)]
        w, i = np.nonzero(np.unpackbits(found, axis=1, count=len(self.ids)) & (self.sizes == size))
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        yield from zip(w[close].tolist(), i[close].tolist(), strict=True)

    def match(self, words: np.ndarray, runs: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one document: each item's best window, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        where: dict[int, list[int]] = {}
        for p in hits.tolist():
            for n in self.owner_sizes[int(np.searchsorted(self.runs, runs[p]))]:
                where.setdefault(n, []).append(p)
        for n in self.short:
            if len(words) >= n:  # windows of under five words: all of them
                h = np.full(len(words) - n + 1, n, U64)
                for j in range(n):
                    h = mix64(h * U64(0x2545F4914F6CDD1D) + words[j : len(words) - n + 1 + j])
                known = np.flatnonzero(np.isin(h, self.runs))
                self.windows(best, n, known, h, 1, n)
            elif len(words):
                self.windows(best, n, np.zeros(1, np.int64), runs_of(words), 1, len(words))
        for n, places in where.items():
            if n < K:
                continue
            m = n - K + 1
            if len(runs) <= m:
                self.windows(best, n, np.zeros(1, np.int64), runs, len(runs), min(n, len(words)))
                continue
            p = np.array(places)
            edge = np.zeros(len(runs) + 2, np.int32)
            np.add.at(edge, np.maximum(p - m + 1, 0), 1)
            np.add.at(edge, p + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[: len(runs) - m + 1])
            self.windows(best, n, starts, runs, m, n)
        return [(item, *found) for item, found in sorted(best.items())]

    def windows(self, best: dict, size: int, starts: np.ndarray, runs: np.ndarray, m: int, width: int) -> None:
        if not len(starts):
            return
        cuts = np.flatnonzero(np.diff(starts) > m) + 1
        for part in np.split(starts, cuts):
            for lo in range(0, len(part), 4096):
                s = part[lo : lo + 4096]
                first, last = int(s[0]), int(s[-1]) + m
                sums = np.zeros((last - first + 1, 64), np.int32)
                np.cumsum(signs(runs[first:last]), axis=0, out=sums[1:])
                prints = simhash(sums[s - first + m] - sums[s - first])
                for w, i in self.near(prints, size):
                    at = int(s[w])
                    x = similarity(self.counts[i], Counter(runs[at : at + m].tolist()))
                    if x >= self.least and (i not in best or x > best[i][0] or x == best[i][0] and at < best[i][1]):
                        best[i] = (x, at, width)

    def batch(self, col: pa.Array) -> Iterator[tuple[int, list]]:
        """(row, matches) of the texts that match."""
        data, offs = binary_parts(col)
        for lo, hi in slices(offs):
            part, o = LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
            starts, ends, at = word_spans(part, o)
            words = Rolling(part).of(starts, ends) if len(starts) else np.zeros(0, U64)
            runs, run_at = shingles(words, at, K)
            hits = self.hits(runs)
            cut = np.searchsorted(hits, run_at)
            held = np.zeros(hi - lo, bool)
            held[np.searchsorted(run_at, hits, "right") - 1] = True
            if self.short:  # items of under five words: texts without a run of five, and all others, are looked at
                held |= np.diff(at) > 0
            for d in np.flatnonzero(held).tolist():
                x, y = run_at[d], run_at[d + 1]
                own = words[at[d] : at[d + 1]]
                got = self.match(own, runs[x:y], hits[cut[d] : cut[d + 1]] - x)
                if got:
                    yield lo + d, got


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), utf8("text")).toLocalIterator():
        held.append((r[0], bytes(r[1])))
        n += len(r[1].split())
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000, **options) -> DataFrame:
    """A row for each document (row of docs) and item that it holds."""
    spark, out = docs.sparkSession, None
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("b"))
    for items in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(Index(items, **options))
        part = d.mapInArrow(_leak_rows(shared), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _leak_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[d], index.ids[i], x, at, n, True) for d, got in index.batch(b.column(1)) for i, x, at, n in got]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words", "contaminated"])

    return run


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000, **options) -> DataFrame:
    """docs without those that hold an item; the rows stay as they are."""
    spark, place, schema = docs.sparkSession, docs.columns.index("text"), docs.schema
    for items in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(Index(items, **options))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _ in shared.value.batch(b.column(place))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
