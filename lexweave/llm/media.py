"""Texts as media: payloads stored losslessly as 8-bit grey PNG members of archives, and a data source that reads them back.

Writing: every task streams its members into one ZIP archive in the shared folder and returns the archive's name; names of
attempts that Spark kept make the table of archives, so that leftovers of lost attempts are never read. Reading: the
data source reads only the archives' directories, plans byte ranges of about `range_bytes` over the members, and streams them
through Arrow in batches. Each range is read front to back; a member that fails (check sum, short read) is read again
by its own offset, up to `retries` times, without repeating the rest.

Defined cases: null is empty; an empty text is padded to one row of 64 zero bytes; equal texts have equal values; null and repeated
ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, utf8

ROW = 64
MEMBER_SCHEMA = "archive string, member string, member_offset long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
HEAD = struct.Struct("<4s5H3I2H")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def png_encode(payload: bytes, level: int = 1) -> bytes:
    """Bytes, a multiple of 64 of them, as an 8-bit grey image of that width; no row filter."""
    rows = len(payload) // ROW
    raw = np.zeros((rows, ROW + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", ROW, rows, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, level)) + part(b"IEND", b"")


def png_decode(media: bytes) -> bytes:
    """The samples of an image that png_encode made."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, shape = 8, [], (0, 0)
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">2I", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, folder: str | None = None) -> list[tuple[str, int]]:
    """Archives (name, members) of docs(doc_id, text) in a folder that all executors share."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/lexweave/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        name, n = f"{uuid.uuid4().hex}.zip", 0
        with filesystem.open_output_stream(f"{root}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = text.as_py()
                    z.writestr(zipfile.ZipInfo(f"{n}/{'null' if doc is None else doc}/{len(data)}.png"), png_encode(pad(data)))
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n"])
        else:
            filesystem.delete_file(f"{root}/{name}")

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("b")).mapInArrow(run, "archive string, n long").collect()
    return [(f"{folder}/{r['archive']}", r["n"]) for r in kept]


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int, members: int):
        self.archive, self.start, self.end, self.members = archive, start, end, members


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = json.loads(options["archives"])
        self.range_bytes, self.batch_bytes = int(options.get("range_bytes", 32 << 20)), int(options.get("batch_bytes", 8 << 20))
        self.retries, self.wait_s = int(options.get("retries", 3)), float(options.get("wait_s", 0.05))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives:
            filesystem, path = _filesystem(archive)
            with filesystem.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                members, end = sorted(i.header_offset for i in z.infolist()), z.start_dir
            lo = 0
            while lo < len(members):
                hi = int(np.searchsorted(members, members[lo] + self.range_bytes, "left"))
                hi = max(hi, lo + 1)
                out.append(ByteRange(archive, members[lo], members[hi] if hi < len(members) else end, hi - lo))
                lo = hi
        return out or [ByteRange("", 0, 0, 0)]

    @staticmethod
    def member(f, at: int) -> tuple[str, bytes, int]:
        """Name, content and next offset of the member whose header is at an offset."""
        f.seek(at)
        head = f.read(HEAD.size)
        magic, _, flags, method, _, _, crc, packed, size, n, m = HEAD.unpack(head)
        name, extra = f.read(n).decode(), f.read(m)
        if magic != b"PK\x03\x04" or method:
            raise OSError(f"no stored member at {at}")
        tail = 0
        if flags & 8:  # sizes follow the data: they are in the name's directory entry only, so take the PNG's own length
            size, crc, tail = ArchiveReader.png_length(f, at + HEAD.size + n + m), None, 16
            f.seek(at + HEAD.size + n + m)
        elif size == 0xFFFFFFFF:
            size = struct.unpack_from("<Q", extra, 4)[0]
        data = f.read(size)
        if len(data) != size or crc is not None and zlib.crc32(data) != crc:
            raise OSError(f"damaged member at {at}")
        if tail:
            f.seek(at + HEAD.size + n + m + size)
            if f.read(tail)[:8] != b"PK\x07\x08" + struct.pack("<I", zlib.crc32(data)):
                raise OSError(f"damaged member at {at}")
        return name, data, at + HEAD.size + n + m + size + tail

    @staticmethod
    def png_length(f, at: int) -> int:
        pos = at + 8
        while True:
            f.seek(pos)
            n, kind = struct.unpack(">I4s", f.read(8))
            pos += 12 + n
            if kind == b"IEND":
                return pos - at

    def read(self, p: ByteRange) -> Iterator[pa.RecordBatch]:
        if not p.members:
            return
        filesystem, path = _filesystem(p.archive)
        f, at, rows, held = filesystem.open_input_file(path), p.start, [], 0
        try:
            for _ in range(p.members):
                for attempt in range(self.retries + 1):
                    try:
                        name, data, after = self.member(f, at)
                        break
                    except (OSError, struct.error):
                        if attempt == self.retries:
                            raise
                        f.close()
                        time.sleep(self.wait_s * 2**attempt)
                        f = filesystem.open_input_file(path)
                rows.append((p.archive, name, at, len(data), data))
                at, held = after, held + len(data)
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            f.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member", "member_offset", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("archives", json list of ZIP files)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, archives: list[str], **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(archives=json.dumps(archives), **options).load()


def feature(payload: bytes) -> str:
    """Mean, deviation and a mean hash of 64 cells of the samples."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) if len(x) >= 64 else np.zeros(64)
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};hash={bits}"


def digest(members: DataFrame) -> DataFrame:
    """Members read back to the columns of the contract."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = m.as_py()
                payload = png_decode(media)
                _, doc, n = name.removesuffix(".png").split("/")
                rows.append((None if doc == "null" else int(doc), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]) if rows else pa.RecordBatch.from_pylist([], b.schema)

    return members.select("member", "media").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    made = write_archives(docs)
    return digest(read_archives(docs.sparkSession, [name for name, _ in made]))
