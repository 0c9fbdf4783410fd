"""Token counts of whole texts with a public tokenizer.

Texts up to `huge` characters are encoded at once. Longer ones are cut at the strings of special tokens, which the library cuts out before all
else, and then into chunks of about `chunk` characters that overlap; each is encoded with offsets, and neighbours are spliced at a stable
common boundary: a place in the overlap that ends a pre-token whatever stands around it (a letter or digit before a white space or a mark of
punctuation, a printable ASCII sign before a white space), so that byte-pair merges never reach over it, where both encodings
begin a token and agree in the `proof` tokens before or behind. A chunk ends `overlap` characters after such a place, the first after its
length; a stretch that has none, as in scripts without spaces and marks, is one chunk. Where the encodings do not align, the overlap
is widened twofold, up to the whole chunk. Special tokens that take white space with them or stand for whole words only are left to the library, with the whole text.

Encoding is the library's of the vocabulary file. Where `ranks` names the same byte-level vocabulary for tiktoken, texts of Latin letters and
common signs up to `huge` go through that, four times as fast, after both have agreed on a set of probes; in these
characters the two libraries' classes of letters, digits and spaces are the same.

Defined cases: null is empty and has 0 tokens; special strings inside texts are what the library makes of them by
default; equal texts have equal counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters over which both libraries' pre-tokens are the same.
PLAIN = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")
PROBES = ["", " ", "Word word's  it'll I'VE\n\n x\t\ty", "Ünïcode \u00a0 \u0085\u00b2\u00bd 12345 1,000.00!?...", "a" * 300, " \n \n  b", "€ – — “q” …", "\x00\x01\x7f"]
STABLE = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \t\r\n])|(?<=[\p{L}\p{N}])(?=[!\"(),.:;?、。，！？；：「」।؟،])")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def load_ranks(path: str, pattern: str):
    """The vocabulary as tiktoken's encoding, without special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def between_specials(tokenizer) -> tuple[re.Pattern | None, bool]:
    """A pattern of the special tokens' strings, the longest first, and whether a text may be cut at them."""
    added = list(tokenizer.get_added_tokens_decoder().values())
    found = re.compile("|".join(re.escape(x.content) for x in sorted(added, key=lambda x: -len(x.content)))) if added else None
    return found, not any(x.lstrip or x.rstrip or x.single_word or x.normalized and tokenizer.normalizer is not None for x in added)


def splice(left: list[tuple[int, int]], right: list[tuple[int, int]], text: str, lo: int, hi: int, proof: int = 4) -> int | None:
    """A stable common boundary in text[lo:hi] of two token lists (absolute offsets), or None."""
    a, b = ({s: i for i, (s, _) in reversed(list(enumerate(x))) if lo <= s < hi} for x in (left, right))
    for m in STABLE.finditer(text, lo, hi):
        i, j = a.get(m.start()), b.get(m.start())
        if i is None or j is None:
            continue
        if i >= proof and j >= proof and left[i - proof : i] == right[j - proof : j] or len(left) >= i + proof and left[i : i + proof] == right[j : j + proof]:
            return m.start()
    return None


def chunk_end(text: str, start: int, chunk: int, overlap: int) -> int:
    """`overlap` characters after the first stable place that lies so far before start + chunk, or later."""
    m = STABLE.search(text, max(start + 1, start + chunk - overlap))
    return len(text) if m is None else min(len(text), m.start() + overlap)


def count_huge(text: str, encode, chunk: int, overlap: int) -> int:
    """Tokens of one text by overlapping chunks; encode(str) gives its tokens' offsets."""
    total, start = 0, 0
    left_start, left_end = 0, chunk_end(text, 0, chunk, overlap)
    left = encode(text[:left_end])
    while left_end < len(text):
        width, end = 2 * overlap, chunk_end(text, left_end, chunk, overlap)
        while True:
            at = max(left_start, left_end - width)
            right = [(s + at, e + at) for s, e in encode(text[at:end])]
            cut = splice(left, right, text, max(at, start + 1), left_end) if at > left_start else None
            if cut is not None:
                total += sum(start <= s < cut for s, _ in left)
                start, left, left_start, left_end = cut, right, at, end
                break
            if at == left_start:  # no boundary is shared: both chunks are one
                left, left_end = right, end
                break
            width *= 2
    return total + sum(s >= start for s, _ in left)


class Counter:
    def __init__(self, path: str, huge: int = 1 << 17, chunk: int = 1 << 15, overlap: int = 256, ranks: tuple[str, str] | None = None):
        """ranks: path and split pattern of the same vocabulary for tiktoken."""
        self.tokenizer = load(path)
        self.special, self.separable = between_specials(self.tokenizer)
        self.fast = load_ranks(*ranks) if ranks else None
        if self.fast and [self.fast.encode_ordinary(p) for p in PROBES] != [self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES]:
            self.fast = None
        self.huge, self.chunk, self.overlap = huge, chunk, overlap

    def encode(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def parts(self, text: str) -> list[str]:
        """A huge text's stretches between special strings; any other text as it is."""
        return self.special.split(text) if len(text) > self.huge and self.special and self.separable else [text]

    def count(self, texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        for i, t in enumerate(texts):
            parts = self.parts(t)
            out[i] = len(parts) - 1
            for p in parts:
                special = self.special is not None and self.special.search(p)
                if len(p) > self.huge and not special:
                    out[i] += count_huge(p, self.encode, self.chunk, self.overlap)
                elif self.fast and not special and PLAIN.fullmatch(p):
                    out[i] += len(self.fast.encode_ordinary(p))
                else:
                    rest.append((i, p))
        for lo in range(0, len(rest), 64):
            part = rest[lo : lo + 64]
            for (i, _), e in zip(part, self.tokenizer.encode_batch_fast([p for _, p in part], add_special_tokens=False), strict=True):
                out[i] += len(e)
        return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, **options) -> DataFrame:
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, **options)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, huge=1 << 15, ranks=(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
