"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training texts (a fold of the ids) give counts of words and word pairs, counted over all of them: each chunk of texts sends its distinct
keys with their counts to buckets of the key range, so that a frequent one moves once from each chunk. A bucket sums them and builds its
part of the filter: a key of count c enters at levels 1 to 1 + floor(log2 c), with `hashes` bits a level. Its count is read
back by probing level after level until one is missing. As 1 + floor(log2 c) <= c, the filter has at most bits_per_entry bits
for each training token and order, and is broadcast while this bound is below `max_filter_bytes`; beyond it, the buckets answer
the probes of the chunks themselves, with the same parts and so with the same values.

Model: P(w | u) = (1 - x) P1(w) + x min(1, c(u, w) / c(u)), P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), with counts from the
filter; x is the share of training pairs that occur again (leaving one out, the chance that a pair was seen).

Defined cases: null and empty texts are one end token; without training texts N = V = 0; null and repeated ids are kept; an empty
table gives no rows; other columns are ignored. Words are told apart by 64-bit hashes, pairs by 48 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, chunk_size, conf_set, input_bytes, stash, unstash
from .packed import pack, unpacked
from .textops import BASE, LOWER, U64, Rolling, mix64, word_spans

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END, START = U64(0x3C79AC492BA7B653), U64(0x1C69B3F74AC4AE35)
WIDTH = (8, 6)
COUNTED = "bucket int, chunk long, width int, keys binary, counts binary"
TOLD = "kind int, chunk long, bucket int, blob binary, x long, y long, z long"


@dataclass(frozen=True)
class Filter:
    """Parts of the filter, one a bucket; a key's bits lie in its bucket's part."""

    buckets: int
    hashes: int = 3
    bits_per_entry: int = 6

    def places(self, keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
        x = mix64(keys ^ U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        y = mix64(x) | U64(1)
        for i in range(self.hashes):
            yield ((x + U64(i) * y) >> U64(1)) % sizes

    def build(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """The bits of one part, for keys of positive count."""
        top = np.floor(np.log2(counts)).astype(np.int64) + 1 if len(counts) else counts
        size = max(64, -(-int(top.sum()) * self.bits_per_entry // 8) * 8)
        bits = np.zeros(size, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            for p in self.places(keys[top >= level], level, U64(size)):
                bits[p.astype(np.int64)] = True
        return np.packbits(bits), size

    def levels(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Highest level that is there with all below; start and sizes: of each key's part, in bits."""
        out, left, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(left):
            level += 1
            ok = np.ones(len(left), bool)
            for p in self.places(keys[left], level, sizes[left]):
                p = p.astype(np.int64) + start[left]
                ok &= (data[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
            left = left[ok]
            out[left] = level
        return out


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for none."""
    x = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (x / 2 + x - 1) / 2, 0.0)


class Tokens:
    """A chunk's tokens: words and an end for each text; its distinct keys and pairs, with training counts."""

    def __init__(self, b: pa.RecordBatch, i: int, modulus: int, held: int):
        self.ids = b.column("ids")[i].as_py()
        data, offs = unpacked(b, i)
        starts, ends, at = word_spans(data, offs)
        words = Rolling(LOWER[data]).of(starts, ends) if len(starts) else np.zeros(0, U64)
        n = np.diff(at)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        last = np.cumsum(n + 1) - 1
        self.key = np.full(len(words) + len(n), END, U64)
        inner = np.ones(len(self.key), bool)
        inner[last] = False
        self.key[inner] = words
        before = np.full(len(self.key), START, U64)
        before[1:] = self.key[:-1]
        before[last[:-1] + 1] = START
        self.before = before
        self.pair = mix64(before * U64(BASE) + self.key) & U64(0xFFFFFFFFFFFF0000)
        self.held = np.array([zlib.crc32(("" if d is None else str(d)).encode()) % modulus == held for d in self.ids], bool)
        train = ~self.held[self.doc] if len(n) else np.zeros(0, bool)
        self.sides = []
        for keys in (self.key, self.pair):
            unique, inverse = np.unique(keys, return_inverse=True)
            self.sides.append((unique, inverse, np.bincount(inverse, weights=train, minlength=len(unique)).astype(np.uint32)))


def count_words(chunks: DataFrame) -> DataFrame:
    """(n): each chunk's words and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(word_spans(*unpacked(b, i))[0]) + len(b.column("ids")[i]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    return chunks.select("chunk", "ids", "lens", "data").mapInArrow(run, "n long")


def count(chunks: DataFrame, buckets: int, modulus: int, held: int) -> DataFrame:
    edges = np.array([(1 << 64) * i // buckets for i in range(1, buckets)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, rows = b.column("chunk")[i].as_py(), []
                for tag, (keys, _, counts) in enumerate(Tokens(b, i, modulus, held).sides):
                    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH[tag] :])
                    rows += [(tag * buckets + int(k), chunk, WIDTH[tag], raw[cut[k] : cut[k + 1]].tobytes(), counts[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut))]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "width", "keys", "counts"])

    return chunks.select("chunk", "ids", "lens", "data").mapInArrow(run, COUNTED)


def gather(counted: DataFrame, f: Filter, probe: bool) -> DataFrame:
    """kind 0: counts of a chunk's words; 1: a part of the filter (x bits); 2: x distinct keys, y tokens, z of keys that repeat; 3: levels of a chunk's keys; 4: as 0, in 64 bits."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        rows = sorted((tuple(b.column(c)[i].as_py() for c in ("chunk", "width", "keys", "counts")) for b in batches for i in range(b.num_rows)), key=lambda r: r[0])
        n = [len(k) // w for _, w, k, _ in rows]
        cut = np.concatenate([[0], np.cumsum(n)])
        flat = np.zeros((cut[-1], 8), np.uint8)
        for (_, width, keys, _), lo, hi in zip(rows, cut[:-1], cut[1:], strict=True):
            flat[lo:hi, 8 - width :] = np.frombuffer(keys, np.uint8).reshape(-1, width)
        counts = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        unique, inverse = np.unique(flat.view(U64).ravel(), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)
        seen = total > 0
        part, size = f.build(unique[seen], total[seen])
        out = [(1, None, bucket, part.tobytes(), size, None, None), (2, None, bucket, None, int(seen.sum()), int(total.sum()), int(total[total > 1].sum()))]
        wide = total.max(initial=0) >= 1 << 32
        tell = [(4, total.astype(U64)) if wide else (0, total.astype(np.uint32))] if bucket < f.buckets else []
        if probe:
            tell.append((3, f.levels(unique, part, np.zeros(len(unique), np.int64), np.full(len(unique), size, U64))))
        for kind, values in tell:
            spreaded = values[inverse]
            out += [(kind, r[0], bucket, spreaded[lo:hi].tobytes(), None, None, None) for r, lo, hi in zip(rows, cut[:-1], cut[1:], strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 3]
        for lo in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 500], strict=True), kinds, strict=True)], ["kind", "chunk", "bucket", "blob", "x", "y", "z"])

    return counted.groupBy("bucket").applyInArrow(run, TOLD)


def _told(b: pa.RecordBatch, i: int, tag: int, buckets: int, kinds: dict) -> np.ndarray:
    """What the buckets of a side told a chunk, in the order of its keys; kinds: to the type of their values."""
    got = sorted((x["bucket"], x["kind"], x["bits"]) for x in b.column("told")[i].as_py() or () if x["kind"] in kinds and x["bucket"] // buckets == tag)
    return np.concatenate([np.frombuffer(bits, kinds[kind]) for _, kind, bits in got]) if got else np.zeros(0, next(iter(kinds.values())))


def score_chunks(chunks: DataFrame, f: Filter, whole, n: int, v: int, seen: float, modulus: int, held: int) -> DataFrame:
    """whole: a broadcast (bits, starts, sizes) of all parts, or None where chunks have been told their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(1 << 64) * i // f.buckets for i in range(1, f.buckets)], U64)
        for b in batches:
            for i in range(b.num_rows):
                t = Tokens(b, i, modulus, held)
                levels = []
                for tag, (keys, _, _) in enumerate(t.sides):
                    if whole is None:
                        levels.append(_told(b, i, tag, f.buckets, {3: np.uint8}))
                    else:
                        data, starts, sizes = whole.value
                        at = np.searchsorted(edges, keys, "right") + tag * f.buckets
                        levels.append(f.levels(keys, data, starts[at], sizes[at]))
                c = _told(b, i, 0, f.buckets, {0: np.uint32, 4: U64}).astype(np.float64)[t.sides[0][1]]
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                word = count_of(levels[0])
                one = (word[t.sides[0][1]] + 0.5) / (n + 0.5 * (v + 1))
                k = np.searchsorted(t.sides[0][0], t.before)
                k[k == len(word)] = 0
                context = np.where(t.sides[0][0][k] == t.before, word[k], 0.0) if len(word) else np.zeros(0)
                context = np.where(t.before == START, word[np.searchsorted(t.sides[0][0], END)] if len(word) else 0.0, context)
                pair = np.minimum(count_of(levels[1])[t.sides[1][1]], context)
                p = np.where(context > 0, (1 - seen) * one + seen * pair / np.maximum(context, 1), one)
                m = len(t.ids)
                total = lambda w: np.bincount(t.doc, weights=w, minlength=m)
                cols = [t.ids, t.held, np.bincount(t.doc, minlength=m), total(c > 0).astype(np.int64), np.full(m, n), total(base), total(np.log10(p))]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.mapInArrow(run, SCHEMA)


def score_texts(docs: DataFrame, modulus: int = 5, held: int = 1, max_filter_bytes: int = 256 << 20, chunk_bytes: int | None = None) -> DataFrame:
    """The columns above for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    size = input_bytes(docs.select("text"))
    f = Filter(int(bucket_count(size, 4 << 20)))
    with conf_set(spark, **{"spark.sql.parquet.compression.codec": "zstd"}):
        chunks = stash(pack(docs, chunk_bytes or chunk_size(size)), "chunks")
        with conf_set(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
            tokens = count_words(chunks).agg(F.sum("n")).first()[0] or 0
            bound = 2 * tokens * f.bits_per_entry // 8
            broadcast = bound <= max_filter_bytes
            told = stash(gather(count(chunks, f.buckets, modulus, held), f, not broadcast), "counts")
            stats = {r["tag"]: r for r in told.filter("kind = 2").groupBy(F.floor(F.col("bucket") / f.buckets).alias("tag")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")).collect()}
            n, v = (int(stats[0]["y"]), int(stats[0]["x"])) if 0 in stats else (0, 0)
            seen = stats[1]["z"] / stats[1]["y"] if 1 in stats and stats[1]["y"] else 0.0
            whole = spark.sparkContext.broadcast(assemble(told.filter("kind = 1").select("bucket", "blob", "x"), f)) if broadcast else None
            per_chunk = told.filter("kind IN (0, 3, 4)").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", F.col("blob").alias("bits"))).alias("told"))
            out = stash(score_chunks(chunks.join(per_chunk, "chunk", "left"), f, whole, n, v, seen, modulus, held), "scores")
    unstash(spark, chunks, told)
    return out


def assemble(parts: DataFrame, f: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in one array; the caller has bounded their size."""
    got = {r["bucket"]: (r["blob"], r["x"]) for r in parts.toLocalIterator()}
    sizes = np.array([got[i][1] if i in got else 64 for i in range(2 * f.buckets)], U64)
    starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    data = np.zeros(int(starts[-1]) // 8, np.uint8)
    for i, (blob, _) in got.items():
        data[starts[i] // 8 : starts[i] // 8 + len(blob)] = np.frombuffer(blob, np.uint8)
    return data, starts[:-1], sizes


def query(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
