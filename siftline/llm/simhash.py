"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits both lie within
``half`` bits of some common value.  So every distinct fingerprint emits all
values within ``half`` bits of it, and fingerprints are linked where they emit
the same value.  All that emit one value are within ``2 * half`` bits of each
other, so linking each to the next of the group loses no link, and a group
holds at most as many distinct fingerprints as a ball has values: copies of one
text are one fingerprint, however many they are.

Defined results: null and empty texts have fingerprint zero; fewer words than a
shingle are hashed as they are; a null id never becomes a component's id unless
all its ids are null; repeated rows are returned as often as they come; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, materialise, raw_texts, sliced

#: Shingles of which the bits are counted at once.
CHUNK = 1 << 16


def hashes(text: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a UTF-8 text in order, repeated ones again, ``CHUNK`` at a time."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        yield np.array([h(joined[a:b], seed) for a, b in zip(begins[i : i + CHUNK], stops[i : i + CHUNK])], np.uint64)


def vote(chunks: Iterable[np.ndarray]) -> int:
    """An unsigned number with the bits that are set in over half of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for v in chunks:
        n += len(v)
        ones += np.unpackbits(v.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text as an unsigned number: a bit is set if it is set in over half of the shingles' XXH64."""
    return vote(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; ``fp`` is the fingerprint's bit pattern as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints ``nodes(fp)`` that connect all at most ``radius`` (even) bits apart."""
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even")
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    masks = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips])
    ball = nodes.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    before = F.lag("fp").over(W.partitionBy("v").orderBy("fp"))
    met = ball.withColumn("src", before).where("src IS NOT NULL").select("src", F.col("fp").alias("dst")).distinct()
    return met.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: documents are in one component if a chain of links joins their fingerprints."""
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "fps")
    return components(fps, radius)


def components(fps: DataFrame, radius: int = 2) -> DataFrame:
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    label = connected_components(links(nodes.select("fp"), radius))
    n = nodes.join(label.select(F.col("u").alias("fp"), "label"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    n = materialise(n, "members")
    first = n.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = n.join(first, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
