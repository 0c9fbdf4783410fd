"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE, SEED = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_TOKEN = ~IS_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give memory that is free in this process back to the system; workers that wait for a task would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over the batches of a task that releases memory at the task's end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(SEED))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n + 1:
        size = max(n + 1, 1 << 20)
        for name, base in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["p"], _powers["q"]


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        p, self.q = _power(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.take(TABLE, data, out=self.sums[1:])
        self.sums[1:] *= p[: len(data)]
        np.cumsum(self.sums, out=self.sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.q[starts]
        return mix64(h ^ ((ends - starts).astype(U64) * U64(SEED)))


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary column's bytes and offsets, without a copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offs: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text has one of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    tok = table[data]
    first = offs[:-1][offs[:-1] < n]
    before = np.empty(n, bool)
    before[0], before[1:] = False, tok[:-1]
    before[first] = False
    starts = np.flatnonzero(tok & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, tok[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(tok & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and for each text the index of its first; texts of fewer words give none."""
    n = np.diff(at)
    m = np.maximum(n - k + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(m)])
    if not out_at[-1]:
        return np.zeros(0, U64), out_at
    pos = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], m)
    h = words[pos]
    for j in range(1, k):
        h = mix64(h * U64(BASE) + words[pos + j])
    return h, out_at
