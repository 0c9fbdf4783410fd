"""Texts packed to rows of a few megabytes, and an exchange in which such rows ask which of their keys others have too.

A packed row (a chunk) sends its sorted distinct 64-bit keys to buckets of the key range; a bucket answers with two bits a key:
`again` (another chunk has it, or the sender marked it as repeated) and `first` (no chunk of a lower number has
it). A key moves once from each chunk, so that a frequent one never gathers in proportion to its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .textops import U64, binary_parts, slices

PACKED = "chunk long, ids array<long>, lens array<long>, data binary"
ASKED = "bucket int, chunk long, width int, keys binary, marks binary"
ANSWERED = "chunk long, bucket int, bits binary"


def pack(docs: DataFrame, most: int = 2 << 20) -> DataFrame:
    """docs(doc_id, text) to chunks of about `most` bytes; a longer text has one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offs = binary_parts(b.column(1))
            for lo, hi in slices(offs, most):
                ids = pa.array([b.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))
                lens = pa.array([np.diff(offs[lo : hi + 1])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), ids, lens, pa.array([data[offs[lo] : offs[hi]].tobytes()], pa.binary())], ["chunk", "ids", "lens", "data"])
                at += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("b")).mapInArrow(run, PACKED)


def unpacked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk."""
    raw = b.column("data")[i].as_buffer()
    lens = b.column("lens")[i].values.to_numpy(zero_copy_only=False)
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def asks(chunks: DataFrame, keys_of: Callable, buckets: int, columns: list[str]) -> DataFrame:
    """keys_of(batch, row) gives lists of (tag, bytes that are kept of a key, sorted distinct keys, marks)."""
    edges = np.array([(1 << 64) * i // buckets for i in range(1, buckets)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                chunk = b.column("chunk")[i].as_py()
                for tag, width, keys, marks in keys_of(b, i):
                    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 8 - width :])
                    for k in np.flatnonzero(np.diff(cut)):
                        lo, hi = cut[k], cut[k + 1]
                        rows.append((tag * buckets + int(k), chunk, width, raw[lo:hi].tobytes(), np.packbits(marks[lo:hi]).tobytes()))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "width", "keys", "marks"])

    return chunks.select(*columns).mapInArrow(run, ASKED)


def answers(asked: DataFrame) -> DataFrame:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((b.column("chunk")[i].as_py(), b.column("width")[i].as_py(), b.column("keys")[i].as_py(), b.column("marks")[i].as_py()) for b in batches for i in range(b.num_rows))
        n = [len(keys) // width for _, width, keys, _ in rows]
        flat, marks, at = np.zeros((sum(n), 8), np.uint8), np.zeros(sum(n), bool), 0
        for (_, width, keys, mark), k in zip(rows, n, strict=True):
            flat[at : at + k, 8 - width :] = np.frombuffer(keys, np.uint8).reshape(-1, width)
            marks[at : at + k] = np.unpackbits(np.frombuffer(mark, np.uint8), count=k)
            at += k
        keys = flat.view(U64).ravel()
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        s = keys[order]
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(s)]]))
        more = (size > 1) | (np.add.reduceat(marks[order].astype(np.int64), first) > 0 if len(first) else False)
        again, lead = np.zeros(len(s), bool), np.zeros(len(s), bool)
        again[order], lead[order] = np.repeat(more, size), new
        cut, bits = np.concatenate([[0], np.cumsum(n)]), []
        for i in range(len(rows)):
            part = slice(cut[i], cut[i + 1])
            bits.append(np.packbits(np.stack([again[part], lead[part]], 1)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def answered(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """Chunks with all answers to them, in column `told`; what a chunk is told is bounded by its own keys."""
    per_chunk = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))
    return chunks.join(per_chunk, "chunk", "left")


def heard(b: pa.RecordBatch, i: int, tag: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """(again, first) of the sorted keys that a chunk has sent under a tag."""
    parts = sorted((x["bucket"], x["bits"]) for x in b.column("told")[i].as_py() or () if x["bucket"] // buckets == tag)
    return spread([np.unpackbits(np.frombuffer(bits, np.uint8)) for _, bits in parts], keys, buckets)


def spread(parts: list[np.ndarray], keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' bits over the sorted keys of one tag."""
    edges = np.array([(1 << 64) * i // buckets for i in range(1, buckets)], U64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    out, k = np.zeros((len(keys), 2), bool), 0
    for i in np.flatnonzero(np.diff(cut)):
        n = cut[i + 1] - cut[i]
        out[cut[i] : cut[i + 1]] = parts[k][: 2 * n].reshape(n, 2)
        k += 1
    return out
