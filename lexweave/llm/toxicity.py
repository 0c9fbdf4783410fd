"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

A word is the bytes between two white spaces, A-Z lower-cased, with a space before and after. Its log-likelihood under the toxic and under
the ordinary model is a sum over n-grams of bytes: interpolated Kneser-Ney, the highest order with counts of the class, all
lower orders with continuation counts shared by both, so that rare expressions are smoothed alike and an
n-gram whose context neither class knows says nothing. Counts are of documents, not places, and three discounts leave an n-gram of
one document without own weight, so that no single text makes an expression toxic. A word's evidence is the difference of the two log-likelihoods a byte (a
length of `least` at least); a text's is that of its strongest word, mapped to a score by a logistic curve that is 0.7 at the threshold
where the share of toxic texts found, less three times that of ordinary texts hit, is highest; each labelled text is judged
by the model of the other half of the sample.

Training takes at most `max_docs` labelled texts of each class, in the order of a digest of their ids; whole texts are read.

Defined cases: null and empty texts have the evidence of no word, a score below 0.7; without labels of both classes every score
is 0; labels other than 0 and 1 are ignored; null and repeated ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stash, unstash, utf8
from .textops import LOWER, U64, Rolling, binary_parts, mix64, slices, tidy, word_spans

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
CUT = 0.7


class Table:
    """A map of 64-bit keys to numbers, with open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(len(keys) * 2).bit_length())
        self.mask = (1 << bits) - 1
        self.keys, self.values, self.full = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        left, step = np.arange(len(keys)), 0
        slot = (mix64(keys) & U64(self.mask)).astype(np.int64)
        while len(left):
            at = (slot[left] + step) & self.mask
            free = ~self.full[at]
            _, first = np.unique(at[free], return_index=True)
            put, where = left[free][first], at[free][first]
            self.keys[where], self.values[where], self.full[where] = keys[put], values[put], True
            left, step = left[~np.isin(left, put)], step + 1
        self.steps = step

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, is there)"""
        out, there = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        slot, left = (mix64(keys) & U64(self.mask)).astype(np.int64), np.arange(len(keys))
        for step in range(self.steps):
            at = (slot[left] + step) & self.mask
            same = (self.keys[at] == keys[left]) & self.full[at]
            out[left[same]], there[left[same]] = self.values[at[same]], True
            left = left[self.full[at] & ~same]
            if not len(left):
                break
        return out, there


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of words (the last byte lowest), and where each word's begin; contexts end at the word's start."""
    n = ends - starts + 1  # its bytes and the space after
    at = np.concatenate([[0], np.cumsum(n)])
    inner = np.arange(at[-1]) - np.repeat(at[:-1], n)
    place = inner + np.repeat(starts, n)
    padded = np.concatenate([data, [0x20]]).astype(np.uint8)
    last = inner == np.repeat(n - 1, n)
    byte = lambda back: np.where(last & (back == 0), 0x20, np.where(inner - back == -1, 0x20, padded[np.maximum(place - back, 0)])).astype(U64)
    code = byte(0)
    for j in range(1, order):
        code |= np.where(inner - j >= -1, byte(j), U64(0)) << U64(8 * j)
    return code, at


class KneserNey:
    """Evidence of packed n-grams: log P(toxic model) - log P(ordinary model)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = 5, discounts: tuple[float, ...] = (1.0, 1.5, 2.0)):
        """codes: distinct n-grams; counts: (n, 2) of the ordinary and the toxic class."""
        self.order = order
        shared = self.lower(codes, counts.sum(1), order, 0.75)
        contexts, inverse = np.unique(codes >> U64(8), return_inverse=True)
        p, weight = [], []
        for c in range(2):
            own = counts[:, c].astype(float)
            off = np.minimum(own, np.array([0.0, *discounts])[np.minimum(own, len(discounts)).astype(int)])
            total, given = np.bincount(inverse, own, len(contexts)), np.bincount(inverse, off, len(contexts))
            w = np.where(total > 0, given / np.maximum(total, 1), 1.0)
            p.append((own - off) / np.maximum(total, 1)[inverse] + w[inverse] * shared)
            weight.append(w)
        self.grams = Table(codes, np.log(p[1] / p[0]).astype(np.float32))
        self.contexts = Table(contexts, np.log(weight[1] / weight[0]).astype(np.float32))

    @staticmethod
    def lower(codes: np.ndarray, counts: np.ndarray, order: int, discount: float) -> np.ndarray:
        """P of order - 1 of each n-gram, from continuation counts of all classes."""
        levels, own, n = [], codes, counts.astype(float)
        for k in range(order - 1, 0, -1):
            short, inverse = np.unique(own & U64((1 << 8 * k) - 1), return_inverse=True)
            whole = (own >> U64(8 * k)) == 0  # begins with the word: its own counts
            n = np.bincount(inverse, np.where(whole, n, 1.0), len(short))
            levels.append((k, short, n))
            own = short
        p_short, p = np.zeros(1, U64), np.array([1 / 256])
        for k, short, n in reversed(levels):
            context, inverse = np.unique(short >> U64(8), return_inverse=True)
            total, kinds = np.bincount(inverse, n, len(context)), np.bincount(inverse, minlength=len(context))
            below = p[np.searchsorted(p_short, short & U64((1 << 8 * (k - 1)) - 1))] if k > 1 else np.full(len(short), 1 / 256)
            d = np.minimum(discount, n)
            p = (n - d) / total[inverse] + discount * (kinds / total)[inverse] * below
            p_short = short
        return p[np.searchsorted(p_short, codes & U64((1 << 8 * (order - 1)) - 1))]

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        value, there = self.grams.find(codes)
        rest = np.flatnonzero(~there)
        value[rest] = self.contexts.find(codes[rest] >> U64(8))[0]
        return value


class Scorer:
    def __init__(self, model: KneserNey | None, threshold: float = 0.0, slope: float = 4.0, least: int = 8):
        self.model, self.threshold, self.slope, self.least = model, threshold, slope, least

    def strongest(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each text's strongest evidence a byte; 0 without words."""
        out = np.zeros(len(offs) - 1)
        data = LOWER[data]
        starts, ends, at = word_spans(data, offs)
        if self.model is None or not len(starts):
            return out
        _, first, inverse = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        value = np.zeros(len(first))
        for lo in range(0, len(first), 1 << 15):
            part = first[lo : lo + (1 << 15)]
            code, where = word_grams(data, starts[part], ends[part], self.model.order)
            n = np.diff(where)
            value[lo : lo + len(part)] = np.add.reduceat(self.model.evidence(code).astype(float), where[:-1]) / np.maximum(n, self.least)
        has = np.diff(at) > 0
        out[has] = np.maximum.reduceat(value[inverse], at[:-1][has])
        return out

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(offs) - 1)
        x = self.slope * (self.strongest(data, offs) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def batch(self, col: pa.Array) -> np.ndarray:
        data, offs = binary_parts(col)
        parts = [self.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in slices(offs)]
        return np.concatenate(parts) if parts else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """(toxic, half, text) of at most max_docs labelled texts of each class."""
    marked = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    u = F.xxhash64("doc_id")
    chosen = None
    for c in (0, 1):
        part = marked.filter(F.col("toxic") == c).orderBy(u, "doc_id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stash(chosen.distinct(), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * max_docs ids
    return texts.select("toxic", F.pmod(u, F.lit(2)).cast("int").alias("half"), utf8("text").alias("b"))


def gram_counts(sample: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the sample and in how many texts they stand (n, half, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = binary_parts(b.column(2))
            kind = b.column(0).to_numpy() + 2 * b.column(1).to_numpy()
            for lo, hi in slices(offs):
                part, o = LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
                starts, ends, at = word_spans(part, o)
                code, where = word_grams(part, starts, ends, order)
                text = where[at]
                once = [np.unique(code[text[d] : text[d + 1]]) for d in range(hi - lo)]
                for k in range(4):
                    code, n = np.unique(np.concatenate([np.zeros(0, U64), *(once[d] for d in np.flatnonzero(kind[lo:hi] == k))]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], ["kind", "code", "n"])

    got = sample.mapInArrow(tidy(run), "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    codes, inverse = np.unique(got["code"].to_numpy().view(U64), return_inverse=True)
    counts = np.zeros((len(codes), 4))
    np.add.at(counts, (inverse, got["kind"].to_numpy()), got["n"].to_numpy())
    return codes, counts.reshape(-1, 2, 2)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, order: int = 5, least: int = 8) -> Scorer:
    spark = docs.sparkSession
    sample = stash(labelled_sample(docs, labels, max_docs), "sample")
    codes, counts = gram_counts(sample, order)
    if not len(codes) or (counts.sum((0, 1)) == 0).any():
        return Scorer(None)
    model = lambda n: KneserNey(codes[n.sum(1) > 0], n[n.sum(1) > 0], order)
    halves = [Scorer(model(counts[:, 1 - h]), least=least) if (counts[:, 1 - h].sum(0) > 0).all() else Scorer(None) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = binary_parts(b.column(2))
            x = [np.where(b.column(1).to_numpy()[lo:hi] == 0, *(s.strongest(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for s in shared.value)) for lo, hi in slices(offs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(x) if x else np.zeros(0))], ["toxic", "x"])

    judged = sample.mapInArrow(tidy(run), "toxic int, x double").toArrow()
    shared.destroy()
    unstash(spark, sample)
    return Scorer(model(counts.sum(1)), best_threshold(judged["x"].to_numpy(), judged["toxic"].to_numpy()), least=least)


def best_threshold(x: np.ndarray, y: np.ndarray) -> float:
    """Where true positive rate - 3 * false positive rate is highest, in the middle of the gap around it."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    below = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    above = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    edge = np.concatenate([[True], x[1:] > x[:-1], [True]])
    value = np.where(edge, 3 * below + above, -1)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float(x[0] - 1 if k == 0 else x[-1] + 1 if k == len(x) else (x[k - 1] + x[k]) / 2)


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.batch(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), utf8("text").alias("b")).mapInArrow(tidy(run), SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, train(docs, labels.filter(fold("doc_id", 3) != 1)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score is 0.7 or more; the rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.filter(fold("doc_id", 3) != 1)))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.batch(b.column(place)) < CUT))

    return docs.mapInArrow(tidy(run), docs.schema)
