"""Shared helpers: scratch tables in the cluster's shared folder, row keys,
batch slicing and tokenising.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.graph import connected_components as connected_components
from siftline.operators.scratch import saved as materialise

#: Words everywhere are maximal runs of bytes outside this class; ``bytes.split()`` splits on exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return memory that is free in this worker process to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        give_back()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in pc.cast(batch.column(column), pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def with_rid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, text, rid[, row])``: ``rid`` orders documents by id; ``row`` is a struct of all other columns.

    Where ids are unique and not null, ``rid`` is the id itself and costs no
    shuffle.  Else rows with the same id and text share one ``rid`` (a repeated
    row is the same document), rows with one id and different texts are told
    apart by a hash of the text, and null ids come first.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")] if carry else []))
    if unique_ids(docs, id_col):
        return d.withColumn("rid", F.col("doc_id"))
    d = d.withColumn("_h", F.xxhash64("text"))
    keys = materialise(
        d.select("doc_id", "_h").distinct().repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_h")).withColumn("rid", F.monotonically_increasing_id()), "rid"
    )
    k = keys.select(F.col("doc_id").alias("_i"), F.col("_h").alias("_k"), "rid")
    return d.join(k, d["doc_id"].eqNullSafe(k["_i"]) & (d["_h"] == k["_k"]), "left").select("doc_id", "text", "rid", *(["row"] if carry else []))


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null and none comes twice.  Ids are counted by grouping, so nothing is gathered."""
    per = docs.groupBy(F.col(id_col).cast("long").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return not per.where("n > 1 OR i IS NULL").limit(1).count()
