"""What the operators of this package share: tables, folds, keys and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all executors are in this process, a temporary one of our own."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


@contextmanager
def conf_set(spark: SparkSession, **pairs: str):
    """Session settings for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    It survives lost executors, cuts the lineage, and lets Spark drop the shuffle files behind it at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"
    with conf_set(spark, **{CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes that the plan reads, from its statistics (file sizes); counted where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= 1 << 60:
        n = int(df.agg(F.sum(F.octet_length(F.col(df.columns[-1]).cast("string")))).first()[0] or 0)
    return n


def chunk_size(size: int, small: int = 2 << 20, large: int = 16 << 20) -> int:
    """Bytes of a packed row for an input of `size` bytes, so that the number of messages between chunks and buckets grows slowly."""
    return min(large, max(small, size >> 10))


def bucket_count(size: int, small: int = 3 << 20, large: int = 64 << 20) -> int:
    """Buckets of a key range for an input of `size` bytes: each stands for `small` bytes of it, for up to `large` in inputs over 4,096 such."""
    return max(16, size // min(large, max(small, size >> 12)))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def utf8(text: Column | str) -> Column:
    """A text's UTF-8 bytes, null as none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit("").cast("binary"))
