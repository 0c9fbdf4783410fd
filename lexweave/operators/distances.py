"""Distances of all pairs of records: blocks of records meet in the cells of a grid, each cell fills its tables for all of its pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of a block, and tokens; places of the tables that are filled at once; tasks at most.
BLOCK, BLOCK_TOKENS, PLACES, MOST_TASKS = 512, 1 << 18, 1 << 20, 2048
MEASURED = "id1 long, id2 long, lcs long, indel long, edit long, jaccard double"


def _running(best: np.ufunc, rows: np.ndarray) -> None:
    """rows[j] becomes the best of rows[:j + 1]; accumulate() is slower where a row is long."""
    if rows[0].size < 100:
        best.accumulate(rows, axis=0, out=rows)
    else:
        for j in range(1, len(rows)):
            best(rows[j - 1], rows[j], out=rows[j])


def _tables(x: np.ndarray, nx: np.ndarray, first: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCS, edit distance and number of common distinct tokens of each x and each y.

    Rows are padded codes, those of x from the longest down; x's and y's pads differ, so that they add nothing to an LCS. `first`: a token's first
    place in x. The edit table holds distances less the place in y, so that an insertion costs nothing and a row is a running minimum.
    """
    n = y.shape[1]
    kind = np.min_scalar_type(-2 - x.shape[1] - n)
    lcs, edit = np.zeros((2, n + 1, len(x), len(y)), kind)
    common = np.zeros((len(x), len(y)), kind)
    y = np.ascontiguousarray(y.T)
    for i in range(x.shape[1]):
        k = np.count_nonzero(nx > i)
        same = y[:, None, :] == x[:k, i, None]
        common[:k] += same.any(0) & first[:k, i, None]
        now = lcs[:, :k]
        now[1:] = np.maximum(now[1:], now[:-1] + same)
        _running(np.maximum, now)
        now = edit[:, :k]
        now[1:] = np.minimum(now[1:] + 1, now[:-1] - same)
        now[0] = i + 1
        _running(np.minimum, now)
    return lcs[n], edit[ny, :, np.arange(len(ny))].T + ny, common


def measure(left: np.ndarray, ids: np.ndarray, toks: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """MEASURED of every record that is left with every other; lengths of a batch differ by less than a factor of two on each side."""
    size = pc.list_value_length(toks).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    codes = toks.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    _, at = np.unique(row * (codes.max(initial=0) + 1) + codes, return_index=True)
    first = np.zeros(len(codes), bool)
    first[at] = True
    distinct = np.bincount(row[at], minlength=len(size))
    codes = codes.astype(np.min_scalar_type(-2 - codes.max(initial=0)))

    def filled(rows: np.ndarray, values: np.ndarray, pad: int) -> np.ndarray:
        places = np.arange(size[rows].max())
        there = places < size[rows, None]
        out = np.full(there.shape, pad, values.dtype)
        out[there] = values[(start[rows, None] + places)[there]]
        return out

    def classes(side: np.ndarray) -> list[np.ndarray]:
        rows = np.flatnonzero(side)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        return np.split(rows, np.flatnonzero(np.diff(np.frexp(size[rows])[1])) + 1) if len(rows) else []

    for ys in classes(~left):
        wide = max(1, PLACES // (size[ys[0]] + 1))
        for j in range(0, len(ys), wide):
            b = ys[j : j + wide]
            y, high = filled(b, codes, -2), max(1, wide // len(b))
            for xs in classes(left):
                for i in range(0, len(xs), high):
                    a = xs[i : i + high]
                    lcs, edit, common = _tables(filled(a, codes, -1), size[a], filled(a, first, False), y, size[b])
                    total = distinct[a, None] + distinct[b] - common
                    indel = size[a, None] + size[b] - 2 * lcs.astype(np.int64)
                    # halves away from 0, as round() does, without the division's own error
                    ratio = (2 * 10**9 * common.astype(np.int64) + total) // np.maximum(1, 2 * total) / 1e9
                    longs = np.repeat(ids[a], len(b)), np.tile(ids[b], len(a)), lcs.ravel(), indel.ravel(), edit.ravel()
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64, copy=False)) for c in longs), pa.array(ratio.ravel(), mask=(total == 0).ravel())], ["id1", "id2", "lcs", "indel", "edit", "jaccard"])


def all_pairs(s: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """MEASURED of every record of s with every one of t (None: of s); both (id, toks), tokens not null.

    jaccard is rounded to 9 places, and null between two records without tokens. Repeated ids are several records. A record goes to the cells
    of one row or column of the grid; so about 2 / BLOCK records are moved for each pair, and a key has about two blocks.
    """

    def blocks(df: DataFrame) -> int:
        rows, tokens = df.agg(F.count("*"), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
        return 1 + max(rows // BLOCK, tokens // BLOCK_TOKENS)

    def dealt(df: DataFrame, left: bool, own: Column, other: Column) -> DataFrame:
        a, b = (own, other) if left else (other, own)
        return df.select(a.alias("a"), b.alias("b"), F.lit(left).alias("left"), F.col("id").cast("long").alias("id"), "toks")

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        left, ids, toks = (cell.column(c).combine_chunks() for c in ("left", "id", "toks"))
        yield from measure(left.to_numpy(zero_copy_only=False), ids.to_numpy(), toks)

    n = blocks(s)
    m = n if t is None else blocks(t)
    place = lambda k: F.pmod(F.xxhash64("id", "toks"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    cells = dealt(s, True, place(n), every(m)).unionByName(dealt(s if t is None else t, False, place(m), every(n)))
    return cells.repartition(min(MOST_TASKS, 1 + n * m // 4), "a", "b").groupBy("a", "b").applyInArrow(run, MEASURED)
