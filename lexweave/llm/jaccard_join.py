"""N-gram Jaccard join by pigeonhole over a partitioned universe, and its connected components.

A document is its set of distinct word shingles. For a pair with Jaccard similarity >= t whose smaller set lies in a size
band, the symmetric difference is at most H = (1 - t) / t * (largest size of the band). The universe of shingles is hashed
into m segments, d of which also index their one-deletion neighbourhoods, with m + d = H + 1 + spare: then at least
spare + 1 units of budget are left, so that some segment agrees (or agrees but for one shingle where
neighbourhoods are indexed). A set leaves its empty segments out while they stand for at most spare units, two for each of the first d:
of two sets, segments that agree empty, or but for the only shingle of one side, then take no more than spare units, so one key is left.
m and d come from a cost model per band: keys plus chance collisions, from the number of documents of that size and the measured chance
that a shingle of one document stands in another; plans of more than about a key a shingle are not taken. A document indexes its own
band and, as the larger partner, the one below.

Very frequent shingles would make segments agree by chance. Leaving any fixed set of shingles out of both sets never
widens a symmetric difference. So a band has a floor x of rare shingles: sets with x or more of them are indexed without the frequent ones,
sets with less than x + H are indexed with all. Of a linked pair, either both have x rare shingles, or one has less and the other less than x + H;
no pair is lost whichever shingles are taken as frequent.

Equal sets are one node. Nodes that share a key are a group. Every group first ties its nodes to its smallest (a star, not pairs); verified ties make families.
Only groups that still hold several families go on: their pairs of different families are compared by sketches (counts of shingles by
hash, whose distance is never above the symmetric difference), in blocks of neighbouring sizes where a group is larger than `small`, and
what the sketches let through is verified exactly: as pairs where they are few, as blocks of texts where they are many. Links then are closed to components.

Defined cases: null and empty texts have no shingles and link with nothing; texts with fewer words than a shingle are one
shingle; null and repeated ids are kept (a component's id is its smallest non-null id, else null); an empty table gives no
rows; other columns are ignored. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, conf_set, input_bytes, stash, unstash, utf8
from .components import connected_components
from .textops import LOWER, U64, Rolling, binary_parts, mix64, release, shingles, slices, tidy, word_spans


@dataclass(frozen=True)
class Spec:
    """Words a shingle; the least similarity in hundredths; how groups are treated."""

    k: int = 3
    percent: int = 90
    hot_share: float = 0.002
    small: int = 48
    block: int = 1024
    local_hot: int = 4

    def linked(self, inter, n1, n2):
        return 100 * inter >= self.percent * (n1 + n2 - inter)


@dataclass(frozen=True)
class Band:
    """Sizes, widest symmetric difference, floor of rare shingles, and (segments, neighbourhoods, spare) for whole sets and for rare shingles only."""

    low: int
    high: int
    h: int
    floor: int
    plans: tuple[tuple[int, int, int], tuple[int, int, int]]


def make_bands(spec: Spec, counts: dict[int, int], limit: int, agree: float = 1e-4) -> list[Band]:
    """Size bands up to a size; counts: documents by floor(log2(size)); agree: the chance that a shingle of one document stands in another."""
    t, out, low = Fraction(spec.percent, 100), [], 1
    while low <= limit:
        high = max(low, math.floor(low / t))
        h = math.floor((1 - t) / t * high)
        n = counts.get(high.bit_length() - 1, 0)
        out.append(Band(low, high, h, 3 * low // 5, (allocate(h, low, n, agree), allocate(h, max(1, 4 * low // 5), n, min(agree, spec.hot_share / 8)))))
        low = high + 1
    return out


def allocate(h: int, size: int, n: int, agree: float) -> tuple[int, int, int]:
    """Segments m, those with one-deletion neighbourhoods d, and spare budget, at the least expected cost of a set, in keys.

    A segment of c shingles on average has x of them with the chance of a Poisson number; it agrees with that of one of n unrelated sets
    with chance e^-c (e^(c agree) - 1), and its neighbourhood with those that hold one shingle or all but one of the same.
    """
    if not h:
        return 1, 0, 0
    best = None
    for d in sorted({0, 1, h // 4, (h + 1) // 2}):
        base = h + 1 - d
        if base < max(d, 1):
            continue
        m = base
        while m - base < (empty := m * math.exp(-size / m)) + 3 * math.sqrt(empty) and empty > 0.02 and m < 4 * base + 8:
            m += 1
        c = size / m
        keys = m + d * c
        if best and keys > size + 16:
            continue
        whole = math.exp(-c) * math.expm1(min(c * agree, 50.0))
        cost = keys + n * (m * whole + d * c * (math.exp(-c) + c * whole))
        if best is None or cost < best[0]:
            best = cost, m, d, m - base
    return best[1:]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, end to end, and where each set begins."""
    starts, ends, at = word_spans(data, offs)
    words = Rolling(LOWER[data]).of(starts, ends) if len(starts) else np.zeros(0, U64)
    sh, sh_at = shingles(words, at, k)
    sets = []
    for i in range(len(at) - 1):
        if at[i + 1] - at[i] >= k:
            sets.append(np.unique(sh[sh_at[i] : sh_at[i + 1]]))
        elif at[i + 1] > at[i]:
            h = np.array([at[i + 1] - at[i]], U64)
            for w in words[at[i] : at[i + 1]]:
                h = mix64(h * U64(0x2545F4914F6CDD1D) + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, U64))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def segment_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
    return s[at[1:]] - s[at[:-1]]


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix64(segment_sums(mix64(sets ^ U64(0x5851F42D4C957F2D)), at) ^ np.diff(at).astype(U64)).view(np.int64)


def signatures(s: np.ndarray, bands: list[tuple[int, Band]], tag: int) -> np.ndarray:
    """Index keys of one set in the given bands (number, band)."""
    out = []
    for number, b in bands:
        if b.h == 0:
            continue
        m, d, spare = b.plans[tag]
        seg = (mix64(s ^ U64(0xA24BAED4963EE407)) % U64(m)).astype(np.int64)
        x = mix64(s + U64(0x9FB21C651E98DF25))
        sums = np.zeros(m, U64)
        np.add.at(sums, seg, x)
        filled = np.bincount(seg, minlength=m)
        salt = mix64(np.arange(m, dtype=U64) + U64(number << 32 | tag << 60))
        use = filled > 0
        if m - use.sum() + d - use[:d].sum() > spare:
            use[:] = True
        out.append(mix64(sums ^ salt)[use])
        if d:
            near = seg < d
            out.append(mix64((sums[seg[near]] - x[near]) ^ salt[seg[near]]))
    return np.concatenate(out) if out else np.zeros(0, U64)


class Signer:
    def __init__(self, spec: Spec, bands: list[Band], hot: np.ndarray):
        self.spec, self.bands, self.hot = spec, bands, np.sort(hot)
        self.edges = np.array([b.high for b in bands], np.int64)

    def of(self, s: np.ndarray) -> np.ndarray:
        """All keys of a set."""
        n = len(s)
        k = int(np.searchsorted(self.edges, n))
        bands = [(k, self.bands[k])]
        if k and self.spec.percent * n <= 100 * self.bands[k - 1].high:
            bands.append((k - 1, self.bands[k - 1]))
        if max(b.h for _, b in bands) == 0:
            return np.zeros(0, U64)
        if not len(self.hot):
            return signatures(s, bands, 0)
        rare = s[self.hot[np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)] != s]
        plain = [x for x in bands if len(rare) < x[1].floor + x[1].h]
        cold = [x for x in bands if len(rare) >= x[1].floor]
        return np.concatenate([signatures(s, plain, 0), signatures(rare, cold, 1)])


def sketch_width(n: int) -> int:
    return 1 << min(12, max(4, n.bit_length() - 3))


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash, up to 255; halves of a sketch add up to the one of half its width."""
    w = sketch_width(len(s))
    return np.minimum(np.bincount((mix64(s + U64(0x1F83D9ABFB41BD6B)) & U64(w - 1)).astype(np.int64), minlength=w), 255).astype(np.uint8).tobytes()


def folded(rows: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width as rows of a narrower one."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).astype(np.int32)
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] + x[:, x.shape[1] // 2 :]
    return x


def _pack(pairs: np.ndarray) -> bytes:
    return pairs.tobytes()


def folded_all(rows: list[bytes]) -> np.ndarray:
    """Sketches of any widths as rows of the least of these."""
    width = min(map(len, rows))
    out = np.empty((len(rows), width), np.int32)
    for w in {len(r) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r) == w]
        out[at] = folded([rows[i] for i in at], width)
    return out


def describe(docs: DataFrame, spec: Spec) -> DataFrame:
    """kind 0: doc_id, set size n, node, sketch; kind 1: a shingle (node) frequent among n different sets of one stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = binary_parts(b.column(1))
            for lo, hi in slices(offs):
                sets, at = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], spec.k)
                n, fp = np.diff(at), fingerprints(sets, at)
                _, once, same = np.unique(fp, return_index=True, return_inverse=True)
                made = [sketch(sets[at[i] : at[i + 1]]) if n[i] else None for i in once]
                many, count = np.unique(np.concatenate([np.zeros(0, U64), *(sets[at[i] : at[i + 1]] for i in once)]), return_counts=True)
                keep = count >= max(4, spec.hot_share * (hi - lo) / 2)
                more = int(keep.sum())
                kind = np.repeat([0, 1], [hi - lo, more]).astype(np.int32)
                ids = pa.concat_arrays([b.column(0).slice(lo, hi - lo), pa.nulls(more, pa.int64())])
                cols = [pa.array(kind), ids, pa.array(np.concatenate([n, count[keep]])), pa.array(np.concatenate([fp, many[keep].view(np.int64)])), pa.array([*(made[i] for i in same), *[None] * more], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "doc_id", "n", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("b")).mapInArrow(tidy(run), "kind int, doc_id long, n long, node long, sketch binary")


def index(docs: DataFrame, spec: Spec, bands: list[Band], hot: np.ndarray, buckets: int) -> DataFrame:
    """Rows (sig, node) of all signatures that two or more nodes share."""
    shared = docs.sparkSession.sparkContext.broadcast(Signer(spec, bands, hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, held, held_n, salt = shared.value, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal salt
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.concatenate([first, [len(sig)]]))
            hot_row = np.repeat(size > spec.local_hot, size)
            ends = np.zeros(len(sig), bool)  # of a hot signature, two nodes go to its bucket; the rest stay spread
            ends[first] = ends[first + size - 1] = True
            to_bucket = ~hot_row | ends
            bucket = (sig[to_bucket] >> U64(20)) % U64(buckets)
            by = np.argsort(bucket, kind="stable")
            rows = np.stack([sig[to_bucket][by].view(np.int64), node[to_bucket][by]], 1)
            used, cut = np.unique(bucket[by], return_index=True)
            keys, blobs = used.astype(np.int64).tolist(), [_pack(x) for x in np.split(rows, cut[1:])]
            if hot_row.any():
                more = np.stack([sig[hot_row].view(np.int64), node[hot_row]], 1)
                for lo in range(0, len(more), 1 << 16):
                    salt += 1
                    keys.append(buckets + (int(more[lo][1]) + salt) % buckets)
                    blobs.append(_pack(more[lo : lo + (1 << 16)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        for b in batches:
            data, offs = binary_parts(b.column(0))
            for lo, hi in slices(offs):
                sets, at = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], spec.k)
                fp = fingerprints(sets, at)
                _, once = np.unique(fp, return_index=True)
                for i in once:
                    if at[i + 1] > at[i] and len(sig := signer.of(sets[at[i] : at[i + 1]])):
                        held.append((sig, np.full(len(sig), fp[i])))
                        held_n += len(sig)
                if held_n > 400_000:
                    yield flush()
                    held_n = 0
        if held:
            yield flush()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for b in batches for x in b.column("rows")])
        if key[0].as_py() < buckets:
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            rows = rows[new]
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            size = np.diff(np.concatenate([first, [len(rows)]]))
            rows = rows[np.repeat(size > 1, size)]
        for lo in range(0, len(rows), 100_000):
            part = rows[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, i])) for i in range(2)], ["sig", "node"])

    sent = docs.select(utf8("text").alias("b")).mapInArrow(tidy(send), "bucket long, rows binary")
    return sent.groupBy("bucket").applyInArrow(meet, "sig long, node long").distinct()


def verify_pairs(pairs: DataFrame, spec: Spec) -> DataFrame:
    """(a, b, text_a, text_b) to the linked (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            sides = [binary_parts(b.column(i)) for i in (2, 3)]
            for lo in range(0, b.num_rows, 256):
                hi = min(lo + 256, b.num_rows)
                (s1, a1), (s2, a2) = (shingle_sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], spec.k) for d, o in sides)
                for i in range(hi - lo):
                    x, y = s1[a1[i] : a1[i + 1]], s2[a2[i] : a2[i + 1]]
                    keep[lo + i] = spec.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["u", "v"])

    return pairs.mapInArrow(tidy(run), "u long, v long")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, spec: Spec) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets numbered left and those numbered right."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = count[inverse] > 1
    column = np.cumsum(count > 1) - 1
    col, row = column[inverse[wanted]], owner[wanted]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    to_left, to_right = np.full(len(sets), -1), np.full(len(sets), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    width = 1024
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        x, y = np.searchsorted(col, [lo, lo + width])
        c, r = col[x:y] - lo, row[x:y]
        sides = []
        for to, n in ((to_left, len(left)), (to_right, len(right))):
            m, ok = np.zeros((n, width), np.float32), to[r] >= 0
            m[to[r[ok]], c[ok]] = 1
            sides.append(m)
        inter += sides[0] @ sides[1].T
    linked = np.zeros(inter.shape, bool)
    for lo in range(0, len(left), 128):
        got = np.rint(inter[lo : lo + 128]).astype(np.int64)
        linked[lo : lo + 128] = spec.linked(got, sizes[left[lo : lo + 128]][:, None], sizes[right][None, :])
    return forest(linked, left, right, len(sets))


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph on n nodes whose edges are the true cells, by breadth first search."""
    row, col = np.full(n, -1), np.full(n, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    fresh, out = np.ones(n, bool), []
    for root in np.unique(np.concatenate([left, right])).tolist():
        queue = [root] if fresh[root] else []
        fresh[root] = False
        while queue:
            v = queue.pop()
            near = np.zeros(0, np.int64)
            if row[v] >= 0:
                near = right[linked[row[v]]]
            if col[v] >= 0:
                near = np.concatenate([near, left[linked[:, col[v]]]])
            near = np.unique(near[fresh[near]]).tolist()
            fresh[near] = False
            queue += near
            out += [(v, w) for w in near]
    return out


def verify_blocks(members: DataFrame, spec: Spec) -> DataFrame:
    """(cluster, side, text) to links (u, v) between the two sides of a cluster."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sets, sides, seen = [], ([], []), {}
        for b in batches:
            data, offs = binary_parts(b.column("text"))
            side = b.column("side").to_pylist()
            for lo, hi in slices(offs):
                s, at = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], spec.k)
                fp = fingerprints(s, at)
                for i in range(hi - lo):
                    if (k := seen.setdefault(int(fp[i]), len(sets))) == len(sets):
                        sets.append(s[at[i] : at[i + 1]])
                    sides[side[lo + i]].append(k)
        names, (x, y) = list(seen), (np.unique(np.array(z, np.int64)) for z in sides)
        links = block_links(sets, x, y, spec) if len(x) and len(y) else []
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], ["u", "v"])

    return members.groupBy("cluster").applyInArrow(run, "u long, v long")


def may_link(pairs: DataFrame, spec: Spec) -> DataFrame:
    """(a, b, n_a, n_b, sketch_a, sketch_b) to the (a, b) that sketches do not tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            sides = [b.column(i).to_pylist() for i in (4, 5)]
            w = np.array([[len(x) for x in side] for side in sides], np.int64).reshape(2, -1)
            keep = np.zeros(b.num_rows, bool)
            for w1, w2 in {*zip(*w.tolist(), strict=True)}:
                rows = np.flatnonzero((w[0] == w1) & (w[1] == w2))
                for lo in range(0, len(rows), 4096):
                    at = rows[lo : lo + 4096]
                    x, y = (folded([side[i] for i in at], min(w1, w2)) for side in sides)
                    keep[at] = spec.linked((n1[at] + n2[at] - np.abs(x - y).sum(1)) // 2, n1[at], n2[at])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return pairs.mapInArrow(tidy(run), "a long, b long")


def compare_blocks(members: DataFrame, spec: Spec) -> DataFrame:
    """(sig, left, right, side, node, family, n, sketch) to what sketches let through between the sides, of different families.

    kind 0: the pair (a, b); kind 1, where pairs would be many: the node a on side b of a cluster.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, node, family, n, rows = [], [], [], [], []
        for b in batches:
            for c, out in (("side", side), ("node", node), ("family", family), ("n", n)):
                out.append(b.column(c).to_numpy())
            rows += b.column("sketch").to_pylist()
        side, node, family, n = (np.concatenate(x) for x in (side, node, family, n))
        n, own = n.astype(np.int64), bool((side == 2).any())
        left, right = (np.arange(len(node)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found = [np.zeros((2, 0), np.int64)]
        if len(left) and len(right):
            x = folded_all(rows)
            y = x[right]
            for i in left.tolist():
                ok = spec.linked((n[i] + n[right] - np.abs(y - x[i]).sum(1)) // 2, n[i], n[right]) & (family[right] != family[i])
                if own:
                    ok[: i + 1] = False
                j = right[ok]
                found.append(np.stack([np.full(len(j), i), j]))
        i, j = np.concatenate(found, 1)
        if len(i) <= 2 * len(node):
            a, b, kind = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.zeros(len(i), np.int32)
        else:
            i, j = np.unique(i), np.unique(j)
            a, b, kind = np.concatenate([node[i], node[j]]), np.repeat([0, 1], [len(i), len(j)]), np.ones(len(i) + len(j), np.int32)
        at = [pa.array([k.as_py()] * len(a), pa.int64()) for k in key]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *at], ["kind", "a", "b", "sig", "left", "right"])

    return members.groupBy("sig", "left", "right").applyInArrow(run, "kind int, a long, b long, sig long, left long, right long")


def block_members(rest: DataFrame, spec: Spec) -> DataFrame:
    """Rows (sig, node, family, n, sketch) of large groups, once for each pair of blocks that they are compared in.

    Blocks hold about spec.block nodes of one class of sizes; linked sets are of the same class or of neighbouring ones.
    """
    ratio = math.log(100 / spec.percent) if spec.percent < 100 else 1.0
    d = rest.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int"))
    blocks = d.groupBy("sig", "cls").agg(F.ceil(F.count("*") / spec.block).cast("int").alias("blocks"))
    around = blocks.select("sig", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)).alias("cls"), F.col("cls").alias("other"), "blocks")
    around = around.groupBy("sig", "cls").agg(*(F.max(F.when(F.col("other") == F.col("cls") + k, F.col("blocks"))).alias(f"b{k + 1}") for k in (-1, 0, 1)))
    d = d.join(around, ["sig", "cls"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("b1")).cast("int"))
    code = lambda c, i: c.cast("long") * F.lit(1 << 32) + i
    me = code(F.col("cls"), F.col("own"))
    to = lambda blocks, make: F.when(F.col(blocks).isNull(), F.array().cast("array<struct<left:bigint,right:bigint,side:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(F.col(blocks), F.lit(1)) - 1), make))
    place = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    below = to("b0", lambda i: place(code(F.col("cls") - 1, i), me, 1))
    above = to("b2", lambda i: place(me, code(F.col("cls") + 1, i), 0))
    within = to("b1", lambda i: place(code(F.col("cls"), F.least(i, F.col("own"))), code(F.col("cls"), F.greatest(i, F.col("own"))), F.when(i == F.col("own"), 2).when(F.col("own") < i, 0).otherwise(1)))
    return d.select("sig", "node", "family", "n", "sketch", F.explode(F.concat(below, within, above)).alias("at")).select("sig", "at.*", "node", "family", "n", "sketch")


class Join:
    """What the steps of a join share: nodes with their sketches, and texts on demand."""

    def __init__(self, docs: DataFrame, spec: Spec, nodes: DataFrame):
        self.spark, self.docs, self.spec = docs.sparkSession, docs, spec
        self.reps = nodes.groupBy("node").agg(F.min("doc_id").alias("rep"))
        self.sketches = nodes.select("node", "n", "sketch")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """A stashed (node, text), a row for each of the wanted nodes."""
        wanted = stash(wanted.distinct(), "wanted")
        chosen = stash(wanted.join(self.reps, "node").select(F.col("rep").alias("doc_id")).distinct(), "chosen")
        d, c = self.docs.alias("d"), chosen.alias("c")
        own = with_node(d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left_semi"), self.spec)
        out = stash(own.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
        unstash(self.spark, wanted, chosen)
        return out

    def sketched(self, rows: DataFrame) -> DataFrame:
        """A stashed rows(node, ...) with n and sketch."""
        s = self.sketches.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        return stash(rows.join(s, "node"), "sketched")

    def near(self, pairs: DataFrame) -> DataFrame:
        """A stashed (a, b) of the pairs that sketches let through."""
        s = stash(self.sketches.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"]), "sketches")
        one, two = (s.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        out = stash(may_link(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), self.spec), "near")
        unstash(self.spark, s)
        return out

    def verified(self, near: DataFrame) -> DataFrame:
        """A stashed (u, v) of the pairs (a, b) that are linked."""
        texts = self.texts(near.select(F.explode(F.array("a", "b")).alias("node")))
        one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        links = stash(verify_pairs(near.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b"), self.spec), "links")
        unstash(self.spark, texts)
        return links


def jaccard_components(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_shingles, component_id, node (set), group (component) of every row of docs(doc_id, text)."""
    with conf_set(docs.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}):
        return _components(docs, spec)


def _components(docs: DataFrame, spec: Spec) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = stash(describe(docs, spec), "sets")
    nodes = told.filter("kind = 0").select("doc_id", "n", "node", "sketch")
    octaves = nodes.filter("n > 0").groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c"), F.max("n").alias("m"), F.sum("n").alias("s")).collect()
    counts, limit = {int(r["k"]): int(r["c"]) for r in octaves}, max((r["m"] for r in octaves), default=1)
    total, all_shingles = sum(counts.values()), sum(int(r["s"]) for r in octaves)
    frequent = told.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n"))
    agree = float(frequent.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0) / max(1.0, float(total) * all_shingles)
    hot = frequent.filter(F.col("n") >= max(32, spec.hot_share * total)).select("node").collect()  # average size / hot_share at most
    hot_set = np.array([r[0] for r in hot], np.int64).view(U64)
    cand = stash(index(docs, spec, make_bands(spec, counts, limit, agree), hot_set, bucket_count(input_bytes(docs))), "signatures")

    join = Join(docs, spec, nodes)
    pivots = cand.groupBy("sig").agg(F.min("node").alias("pivot"))
    stars = stash(cand.join(pivots, "sig").filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    near = join.near(stars)
    unstash(spark, stars)
    links = join.verified(near)
    families = connected_components(links)
    unstash(spark, near, links)

    rest = cand.join(families, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("family"))
    # Groups of several families; those of the same nodes count once.
    seen = F.struct(F.sum(F.xxhash64("node") % 1_000_000_007), F.sum(F.xxhash64("node", F.lit(1)) % 1_000_000_007)).alias("seen")
    mixed = rest.groupBy("sig").agg(F.count("*").alias("g"), F.min("family").alias("x"), F.max("family").alias("y"), seen).filter("x <> y AND g > 2")
    rest = join.sketched(rest.join(mixed.groupBy("g", "seen").agg(F.min("sig").alias("sig")).select("sig", "g"), "sig"))
    few = rest.filter(F.col("g") <= spec.small).groupBy("sig").agg(F.collect_list(F.struct("node", "family", "n", "sketch")).alias("x"))  # spec.small at most
    through = stash(compare_blocks(block_members(rest.filter(F.col("g") > spec.small).drop("g"), spec), spec), "blocks")
    pairs = stash(compare_lists(few.select("x"), spec).unionByName(through.filter("kind = 0").select("a", "b")).distinct(), "pairs")
    late = [join.verified(pairs)] if pairs.take(1) else []
    dense = through.filter("kind = 1").select(F.xxhash64("sig", "left", "right").alias("cluster"), F.col("b").cast("int").alias("side"), F.col("a").alias("node"))
    if dense.take(1):
        texts = join.texts(dense.select("node"))
        late.append(stash(verify_blocks(dense.join(texts, "node").select("cluster", "side", "text"), spec), "links"))
        unstash(spark, texts)
    unstash(spark, cand, rest, through, pairs)

    roots = families
    if late:  # links between families: their components are those of all
        edges = late[0] if len(late) == 1 else late[0].unionByName(late[1])
        ends = edges.join(families.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(families.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
        joined = connected_components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        inner = families.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = stash(inner.unionByName(joined.join(families.select("node"), "node", "left_anti").select("node", "root")), "roots")
        unstash(spark, families, joined, *late)

    named = roots.join(join.reps, "node").groupBy("root").agg(F.min("rep").alias("component"))
    final = join.reps.join(roots, "node", "left").join(named, "root", "left").select("node", F.coalesce("component", "rep").alias("component_id"), F.coalesce("root", "node").alias("group"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = stash(nodes.join(final, "node").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "node", "group"), "found")
    unstash(spark, told, roots)
    return out


def compare_lists(groups: DataFrame, spec: Spec) -> DataFrame:
    """Lists (node, family, n, sketch) of spec.small entries at most to the pairs (a, b) of different families that sketches let through.

    The smallest node's pairs have been verified as the group's star.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = batch.column(0).offsets.to_numpy(), batch.column(0).values
            node, family, n = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            rows = items.field(3).to_pylist()
            out = [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = folded_all(rows[lo:hi])
                i, j = np.triu_indices(hi - lo, 1)
                own, least = slice(lo, hi), node[lo:hi].min()
                keep = (family[own][i] != family[own][j]) & (node[own][i] != least) & (node[own][j] != least)
                i, j = i[keep], j[keep]
                ok = spec.linked((n[own][i] + n[own][j] - np.abs(x[i] - x[j]).sum(1)) // 2, n[own][i], n[own][j])
                p, q = node[own][i[ok]], node[own][j[ok]]
                out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
            found = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])

    return groups.mapInArrow(tidy(run), "a long, b long")


def with_node(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs(doc_id, text) to (node, text); texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = binary_parts(b.column(0))
            for lo, hi in slices(offs):
                s, at = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], spec.k)
                has = pa.array(np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(s, at)).filter(has), b.column(0).slice(lo, hi - lo).filter(has)], ["node", "text"])

    return docs.select(utf8("text").alias("b")).mapInArrow(tidy(run), "node long, text binary")


def query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
