"""Language identification by compression: one raw-content zstandard dictionary per language, the smallest output wins.

Texts are read as their letters, lower-cased, with a space for every run of other characters. Training: for each language a bounded
sample of labelled rows of the `max_langs` languages with most rows, `dict_docs` distinct texts at most in the order of a digest of their bytes, of which
`dict_bytes` go into the dictionary, an equal share from each, in stretches spread over the whole text; copies of a text count once. Prediction: the whole text is cut into blocks, at character boundaries, so that the
dictionary counts everywhere in long texts; each block is compressed against every dictionary and the sizes are summed.
score is a logistic function of the relative margin between the two smallest sums; below `min_margin` the answer is
marked as rejected (the query still names the closest language, as its contract asks).

Defined cases: null text and text without a letter give `und`, score 0; without a labelled row every text is `und`; ties go to the
language with more labelled rows, then to the one that sorts first; equal texts get equal answers; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def normal(text: str) -> str:
    """Letters in lower case; a space for each run of anything else."""
    import regex

    return regex.sub(r"[^\p{L}]+", " ", text.lower())


def spread(data: bytes, size: int, stretches: int = 4) -> bytes:
    """`size` bytes in stretches from the beginning to the end, without parts of characters."""
    if len(data) <= size:
        return data
    n = size // stretches
    return b" ".join(data[at : at + n].decode("utf-8", "ignore").strip().encode() for at in ((len(data) - n) * i // (stretches - 1) for i in range(stretches)))


def stretches_of(text: Column, size: Column, stretches: int = 4) -> Column:
    """The same for the characters of a text."""
    n = F.floor(size / stretches).cast("int")
    at = [F.floor((F.length(text) - n) * i / (stretches - 1)).cast("int") + 1 for i in range(stretches)]
    return F.when(F.length(text) <= size, text).otherwise(F.concat_ws(" ", *(F.substring(text, a, n) for a in at)))


def train_dictionaries(rows: DataFrame, dict_docs: int = 256, dict_bytes: int = 64 << 10, max_langs: int = 1000) -> dict[str, bytes]:
    """rows(text, lang) to a dictionary per language, most rows first; what reaches the driver is 4 * dict_bytes characters a language."""
    d = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select(F.col("lang").cast("string").alias("lang"), "text")
    langs = [r["lang"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    d = d.filter(F.col("lang").isin(langs)).withColumn("u", F.xxhash64("text"))
    chosen = d.select("lang", "u").distinct().withColumn("salt", F.pmod("u", F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):  # a hot language is thinned in 64 parts first
        chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("u"))).filter(F.col("n") <= dict_docs).drop("n")
    chosen = chosen.select("lang", "u", F.floor(dict_bytes / F.count("*").over(W.partitionBy("lang"))).alias("share"))
    # dict_docs * max_langs keys at most
    d = d.join(F.broadcast(chosen), ["lang", "u"]).select("lang", "u", "share", stretches_of(F.col("text"), 4 * F.col("share")).alias("piece"))
    pieces: dict[str, list[bytes]] = {}
    for lang, _, piece, share in sorted((r["lang"], r["u"], r["piece"], r["share"]) for r in d.groupBy("lang", "u", "share").agg(F.min("piece").alias("piece")).toLocalIterator()):
        pieces.setdefault(lang, []).append(spread(normal(piece).encode("utf-8", "surrogatepass"), share))
    return {k: b" ".join(pieces[k]) for k in langs}


def blocks(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 2048, min_margin: float = 0.01, slope: float = 60.0):
        import regex
        import zstandard

        self.langs, self.block, self.min_margin, self.slope = list(dictionaries), block, min_margin, slope
        self.letter = regex.compile(r"\p{L}")
        self.coders = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not self.letter.search(text):
            return "und", 0.0, True
        sizes = [0] * len(self.langs)
        for part in blocks(normal(text).encode("utf-8", "surrogatepass"), self.block):
            for i, c in enumerate(self.coders):
                sizes[i] += len(c.compress(part))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], 1 / (1 + math.exp(-self.slope * margin)), margin < self.min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], **options) -> DataFrame:
    """docs(doc_id, held_out, text) to the schema above."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, **options)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(2)]
            lang, score, rejected = ([x[i] for x in got] for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    d = docs.select("doc_id", "text", "lang", held)
    return identify(d, train_dictionaries(d.filter(~F.col("held_out")).select("text", "lang")))
