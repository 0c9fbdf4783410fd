"""Repeated passages, by a difference cover to the depth of a passage, over hashes in place of ranks.

The difference-cover method sorts the suffixes at sampled places (places modulo v in a set D whose differences give every
residue), names them, treats further only those whose names repeat, and settles the remaining suffixes through a sampled place at a common
distance. Taken here are the cover, the names, the recursion on names that repeat and the merge through a common distance; not taken is the
lexicographic order: names are hashes, sorted over ranges of hashes, and neighbours in that order are compared for equality, which is
all that repeats of a fixed length need. Strings are compared to a depth of `length` = 200 bytes, and v = 133
with the 12 places of a perfect difference set in place of 3 with 2, so that 9 % of the places are named instead of 67 %:

1. the sampled tuples, of length - v + 1 = 68 bytes, are sorted over ranges of their names, and every
   chunk of texts hears which of its names stand anywhere else; a name that stands once ends there;
2. two equal strings of 200 bytes have a sampled place at one distance below 133 from both starts, whose tuples are equal.
   So only starts up to 132 bytes before a repeated name remain; for these, names of the full 200 bytes are sorted in the
   same way, and equal neighbours are repeats.

Whole texts that occur again are settled in step 1 (their first copy answers for all in step 2). Chunks and buckets grow with the input, so
that the number of messages between them stays in proportion to the keys.

Defined cases: null is empty; texts under 200 bytes keep all; texts are judged on the input, bytes are removed whatever character they
cut; null and repeated ids are kept; an empty table gives no rows; other columns are ignored. Equality of 200-byte strings and of
whole texts is that of 64-bit fingerprints; the 40 bits of step 1 only choose what step 2 looks at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, chunk_size, conf_set, input_bytes, stash, unstash, utf8
from .packed import PACKED, answered, answers, asks, heard, pack, unpacked
from .textops import U64, Rolling

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, crc long, kept binary"
OPEN = f"{PACKED}, starts array<long>, ends array<long>, copied array<boolean>, done array<struct<{RESULT.replace(' ', ':').replace(',:', ',')}>>"
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


@cache
def difference_set(q: int = 11) -> tuple[int, tuple[int, ...]]:
    """(v, D): Singer's perfect difference set of q + 1 residues modulo q * q + q + 1, for a prime q."""
    v = q * q + q + 1
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):  # x^3 = a x^2 + b x + c
        x, places = (0, 0, 1), []
        for i in range(v):
            if x[0] == 0:
                places.append(i)
            x = ((x[1] + a * x[0]) % q, (x[2] + b * x[0]) % q, c * x[0] % q)
        if len(places) == q + 1 and len({(i - j) % v for i in places for j in places}) == v:
            return v, tuple(places)
    raise ValueError(q)


def window_names(data: np.ndarray, at: np.ndarray, width: int, block: int = 2 << 20) -> np.ndarray:
    """Fingerprints of data[p : p + width] for sorted places p."""
    out = np.empty(len(at), U64)
    for lo in range(0, len(data), block):
        x, y = np.searchsorted(at, [lo, lo + block])
        if x < y:
            p = at[x:y] - lo
            out[x:y] = Rolling(data[lo : lo + block + width]).of(p, p + width)
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


class Cover:
    def __init__(self, length: int = 200, q: int = 11):
        self.length = length
        self.v, self.places = difference_set(q)
        self.width = length - self.v + 1
        assert self.width > 0

    def samples(self, offs: np.ndarray) -> np.ndarray:
        """Sampled places of the texts that are long enough."""
        out = []
        for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if hi - lo >= self.length:
                n = -(-(hi - lo) // self.v)
                p = (np.arange(n)[:, None] * self.v + np.array(self.places)).ravel()
                out.append(lo + np.sort(p[p + self.width <= hi - lo]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def sample_names(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.samples(offs)
        return at, window_names(data, at, self.width) & U64(0xFFFFFFFFFF000000)

    def text_names(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        digest = lambda lo, hi: int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        return np.array([digest(lo, hi) for lo, hi in zip(offs[:-1], offs[1:], strict=True) if hi - lo >= self.length], U64)


def counted(keys: np.ndarray, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, marks of those that stand twice or are marked, and each key's index."""
    unique, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    marks = n > 1
    if marked is not None and len(marks):
        marks = marks | (np.bincount(inverse, weights=marked, minlength=len(unique)) > 0)
    return unique, marks, inverse


def _names(cover: Cover):
    def keys_of(b: pa.RecordBatch, i: int) -> list:
        data, offs = unpacked(b, i)
        names, marks, _ = counted(cover.sample_names(data, offs)[1])
        texts, again, _ = counted(cover.text_names(data, offs))
        return [(0, 5, names, marks), (1, 8, texts, again)]

    return keys_of


def _settle(cover: Cover, buckets: int, keep: bool):
    """Step 1's answers: what is done, and the texts with starts that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(b, i)

    def one(b: pa.RecordBatch, i: int) -> pa.RecordBatch:
        data, offs = unpacked(b, i)
        ids = b.column("ids")[i].as_py()
        at, names = cover.sample_names(data, offs)
        unique, marks, inverse = counted(names)
        again = heard(b, i, 0, unique, buckets)[:, 0] | marks
        hit = at[again[inverse]]
        edge = np.zeros(len(data) + 2, np.int32)
        np.add.at(edge, np.maximum(hit - cover.v + 1, 0), 1)
        np.add.at(edge, hit + 1, -1)
        near = np.cumsum(edge)[: len(data)] > 0
        texts, repeated, index = counted(cover.text_names(data, offs))
        told = heard(b, i, 1, texts, buckets)
        repeated = repeated | told[:, 0]
        seen, k = set(), 0
        done, left = [], []
        for d, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            copied = lead = False
            if hi - lo >= cover.length:
                copied = bool(repeated[index[k]])
                lead = bool(told[index[k], 1]) and index[k] not in seen
                seen.add(index[k])
                k += 1
                near[hi - cover.length + 1 : hi] = False
            else:
                near[lo:hi] = False
            if copied:
                near[lo : hi - cover.length + 1] = lead
            if near[lo:hi].any():
                left.append((d, lo, hi, copied))
            elif copied:
                done.append((ids[d], hi - lo, hi - lo, 1, hashlib.sha256().hexdigest(), zlib.crc32(data[lo:hi]) if keep else None, b"" if keep else None))
            elif not keep:
                done.append((ids[d], hi - lo, 0, 0, hashlib.sha256(data[lo:hi]).hexdigest(), None, None))
        body = np.concatenate([data[lo:hi] for _, lo, hi, _ in left]) if left else np.zeros(0, np.uint8)
        starts, ends = runs(np.concatenate([near[lo:hi] for _, lo, hi, _ in left]) if left else np.zeros(0, bool))
        cols = {
            "chunk": [b.column("chunk")[i].as_py()], "ids": [[ids[d] for d, *_ in left]], "lens": [[hi - lo for _, lo, hi, _ in left]], "data": [body.tobytes()],
            "starts": [starts], "ends": [ends], "copied": [[c for *_, c in left]], "done": [[dict(zip((n for n, _ in ARROW_RESULT), x, strict=True)) for x in done]],
        }
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), ARROW_OPEN, strict=True)], list(cols))

    return run


_longs = pa.list_(pa.int64())
ARROW_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("crc", pa.int64()), ("kept", pa.binary())]
ARROW_OPEN = [pa.int64(), _longs, _longs, pa.binary(), _longs, _longs, pa.list_(pa.bool_()), pa.list_(pa.struct(ARROW_RESULT))]


def _remaining(cover: Cover, b: pa.RecordBatch, i: int) -> tuple:
    """A chunk's open texts, the starts that remain in them, their names, and which stand in copied texts."""
    data, offs = unpacked(b, i)
    edges = [b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends")]
    n = edges[1] - edges[0]
    at = np.arange(n.sum()) + np.repeat(edges[0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
    copied = b.column("copied")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    marked = copied[np.searchsorted(offs, at, "right") - 1] if len(at) else np.zeros(0, bool)
    return data, offs, at, window_names(data, at, cover.length), marked


def _starts(cover: Cover):
    def keys_of(b: pa.RecordBatch, i: int) -> list:
        *_, names, marked = _remaining(cover, b, i)
        unique, marks, _ = counted(names, marked)
        return [(0, 8, unique, marks)] if len(unique) else []

    return keys_of


def _remove(cover: Cover, buckets: int, keep: bool):
    """Step 2's answers: bytes under repeated starts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, offs, at, names, marked = _remaining(cover, b, i)
                unique, marks, inverse = counted(names, marked)
                again = heard(b, i, 0, unique, buckets)[:, 0] | marks
                hit = at[again[inverse]] if len(at) else at
                edge = np.zeros(len(data) + cover.length + 1, np.int32)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + cover.length, -1)
                gone = np.cumsum(edge)[: len(data)] > 0
                if keep and len(data):  # of a character, all bytes go or none
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    lead = lead if len(lead) and lead[0] == 0 else np.concatenate([[0], lead])
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.concatenate([lead, [len(data)]])))
                rows = []
                for doc, lo, hi in zip(b.column("ids")[i].as_py(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    kept = data[lo:hi][~gone[lo:hi]].tobytes()
                    if not keep or len(kept) < hi - lo:
                        rows.append((doc, hi - lo, hi - lo - len(kept), len(runs(gone[lo:hi])[0]), hashlib.sha256(kept).hexdigest(), zlib.crc32(data[lo:hi]) if keep else None, kept if keep else None))
                cols = zip(*rows, strict=True) if rows else [[]] * len(ARROW_RESULT)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, ARROW_RESULT, strict=True)], [n for n, _ in ARROW_RESULT])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text); with `keep` only of those that lose bytes, and crc of the text and the kept bytes."""
    spark, cover = docs.sparkSession, Cover(length)
    size = input_bytes(docs.select("text"))
    buckets = bucket_count(size)
    with conf_set(spark, **SMALL_BATCHES, **{"spark.sql.parquet.compression.codec": "zstd"}):
        with conf_set(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}):
            chunks = stash(pack(docs, chunk_size(size)), "chunks")
        told = stash(answers(asks(chunks, _names(cover), buckets, ["chunk", "ids", "lens", "data"])), "names")
        left = stash(answered(chunks, told).mapInArrow(_settle(cover, buckets, keep), OPEN), "open")
        unstash(spark, chunks, told)
        open_only = left.select("chunk", "ids", "lens", "data", "starts", "ends", "copied").filter(F.size("ids") > 0)
        told = stash(answers(asks(open_only, _starts(cover), buckets, open_only.columns)), "starts")
        late = answered(open_only, told).mapInArrow(_remove(cover, buckets, keep), RESULT)
        done = left.select(F.explode("done").alias("d")).select("d.*")
        out = stash(done.unionByName(late), "removed")
        unstash(spark, left, told)
    return out if keep else out.drop("crc", "kept")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs without their repeated passages: whole characters go, n_chars follows where the column is there; every row stays.

    What goes of a text depends on the text and the table only, so changed texts are tied to their rows by two hashes and the length.
    """
    key, hashes = ["__hash__", "__crc__", "__bytes__"], [F.xxhash64(utf8("text")), F.crc32(utf8("text")), F.octet_length(utf8("text")).cast("long")]
    found = remove_repeats(docs.select(hashes[0].alias("doc_id"), "text"), length, keep=True)
    kept = found.groupBy(F.col("doc_id").alias(key[0]), F.col("crc").alias(key[1]), F.col("n_bytes").alias(key[2])).agg(F.first("kept").alias("__kept__"))
    out = docs.withColumns(dict(zip(key, hashes, strict=True))).join(kept, key, "left")
    out = out.withColumn("text", F.when(F.col("__kept__").isNull(), F.col("text")).otherwise(F.col("__kept__").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept__").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
