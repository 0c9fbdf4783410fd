"""Near-duplicate removal: one document of each component of the n-gram Jaccard join stays.

The document of the smallest id stays (null ids last; of equal ids that of the smallest set fingerprint; of equal rows one). Texts
without words all stay. The rows themselves are not changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stash, unstash
from .jaccard_join import Spec, fingerprints, jaccard_components, shingle_sets
from .textops import binary_parts, slices, tidy

NODE = "__node_of_text__"


def with_node(docs: DataFrame, k: int) -> DataFrame:
    """docs and the fingerprint of each text's shingle set (null: no words)."""
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(NODE, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = binary_parts(b.column(place))
            out = [pa.nulls(0, pa.int64())]
            for lo, hi in slices(offs):
                s, at = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                out.append(pa.array(fingerprints(s, at), mask=np.diff(at) == 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(out)], [*b.schema.names, NODE])

    return docs.mapInArrow(tidy(run), schema)


def dedup(docs: DataFrame, spec: Spec = Spec(k=5, percent=80)) -> DataFrame:
    found = jaccard_components(docs, spec)
    rows = found.filter("n_shingles > 0").groupBy("doc_id", "node", "group").agg(F.count("*").alias("copies"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f")).select("group", F.col("f.doc_id").alias("keep_id"), F.col("f.node").alias("keep_node"))
    marks = rows.join(first, "group").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node")))
    marks = stash(marks.filter("NOT kept OR copies > 1").select(F.col("doc_id").alias("m_id"), F.col("node").alias("m_node"), "kept"), "marks")
    unstash(docs.sparkSession, found)
    names = {c.lower() for c in docs.columns}
    tag = lambda c: c if c not in names else tag(f"_{c}")
    m_id, m_node = tag("m_id"), tag("m_node")
    marks = marks.select(F.col("m_id").alias(m_id), F.col("m_node").alias(m_node), F.col("kept").alias(tag("kept")))
    d, key = with_node(docs, spec.k), [F.col(NODE) == F.col(m_node), F.col("doc_id").cast("long").eqNullSafe(F.col(m_id))]
    clear = d.join(marks, key, "left_anti").select(*docs.columns)
    again = marks.filter(F.col(tag("kept")))
    if not again.take(1):
        return clear
    one = F.row_number().over(W.partitionBy("doc_id", NODE).orderBy(F.xxhash64("text"))).alias(tag("nth"))
    same = d.join(again, key, "left_semi").select("*", one).filter(F.col(tag("nth")) == 1).select(*docs.columns)
    return clear.unionByName(same)
