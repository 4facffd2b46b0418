"""Template fingerprints and clusters: SimHash over word shingles, exact banded similarity join, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import columns as C
from siftline.functions.parsing import shingle_digests, shingle_votes
from siftline.operators.graph import connected_components
from siftline.operators.scratch import saved


def voted(messages: DataFrame, key: str, body: Column, stripped: Callable[[Column], Column] = C.template_text) -> DataFrame:
    """``(key, fp)`` of messages with a word: a bit is set if more of the distinct shingles' hashes, the low 64 bits of their MD5, have it than not.

    ``stripped`` takes what varies out of a body.  A text's votes are counted
    where it lies, so no row is made of a shingle; only those of texts whose key
    comes again are dealt out, as a shingle of several texts of one key has one vote.
    """
    text = messages.select(key, stripped(body).alias("t"))
    kind = T.StructType([text.schema[key], T.StructField("fp", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [None if t is None else shingle_votes(t) for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
            fp = [None if v is None else int(np.packbits(v > 0).view(">i8")[0]) for v in votes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[key, "fp"])

    again = messages.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again")
    if not again.limit(1).count():
        return text.mapInArrow(count, kind).where("fp IS NOT NULL")
    again = saved(again, "again")
    same = F.col(key).eqNullSafe(F.col("_again"))
    one = text.join(again, same, "left_anti").mapInArrow(count, kind).where("fp IS NOT NULL")
    halves = T.StructType([text.schema[key], T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(pc.cast(b.column(1), pa.binary()).to_pylist()):
                digests = None if t is None else shingle_digests(t)
                if digests is not None:
                    high, low = digests.reshape(-1).view(">i8").astype(np.int64).reshape(-1, 2).T
                    own = b.column(0).take(pa.array(np.full(len(low), i)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(high), pa.array(low)], names=[key, "high", "low"])

    shingles = text.join(again, same, "left_semi").mapInArrow(deal, halves).distinct()
    votes = shingles.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.getbit("low", F.lit(i)).cast("long")).alias(f"b{i}") for i in range(64)])
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long"))
    return one.unionByName(votes.select(key, bits.alias("fp")))


def fingerprints(messages: DataFrame, key: str, body: Column, stripped: Callable[[Column], Column] = C.template_text) -> DataFrame:
    """``(key, fp)`` of all messages; zero without words."""
    return messages.select(key).join(voted(messages, key, body, stripped), key, "left").select(key, F.coalesce("fp", F.lit(0)).alias("fp"))


#: Where the six blocks of a fingerprint begin, and their widths.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def dealt(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """``(fp, choice, bits)``: each fingerprint with its bits in all 20 choices of three blocks.

    Three bits spoil at most three of six blocks, so fingerprints that differ in
    no more agree on three whole blocks, 31 to 33 bits, and few others do.
    """
    if distance > 3:
        raise ValueError("six blocks find distances up to 3")
    masks = [sum(((1 << n) - 1) << at for at, n in chosen) for chosen in combinations(BLOCKS, 3)]
    keys = F.array(*[F.col("fp").bitwiseAND(x - (1 << 64) if x >> 63 else x) for x in masks])
    return nodes.select("fp", F.posexplode(keys).alias("choice", "bits"))


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def similar(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``(src, dst)`` of distinct ``fp`` that differ in at most three bits."""
    d = dealt(nodes, distance)
    other = d.select(F.col("fp").alias("dst"), "choice", "bits")
    pairs = d.withColumnRenamed("fp", "src").join(other, ["choice", "bits"]).where("src < dst").where(near("src", "dst", distance))
    return pairs.select("src", "dst").distinct()


def clusters(fps: DataFrame, key: str, distance: int = 3) -> DataFrame:
    """``(key, label, size)`` of messages in single-linkage groups of two or more; fingerprint zero takes no part."""
    f = saved(fps.where("fp <> 0").select(key, "fp"), "fps")
    label = connected_components(similar(f.select("fp").distinct(), distance), broadcast=False).select(F.col("u").alias("fp"), "label")
    sized = f.join(label.hint("merge"), "fp", "left").select(key, F.coalesce("label", "fp").alias("label"))
    big = sized.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return sized.join(big.hint("merge"), "label")
