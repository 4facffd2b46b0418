"""Near duplicates by the Jaccard similarity of shingle sets: every pair of ``similarity`` or more is found.

Documents with one set of shingles are one node.  Nodes that SimHash's ball
hashing links are checked first, so that large groups of close copies join
before any pairs are listed.  The rest is a prefix filter: with the shingles of
each set in one common order, two sets of n shingles that are similar enough
share one of their first ``n - ceil(similarity * n) + 1``, at places that leave
enough shingles behind them in both.

Nodes that meet on such a shingle are not all paired.  In ``rounds`` of stars,
each is paired with one node of those that share the shingle, that which meets
most; what is similar joins, so a group of copies shrinks to few components.
After them, nodes that still meet in different components are paired.

A pair is given up where a sketch proves it too far apart: the number of
shingles in each of 128 ranges of their hashes bounds from above what two sets
share.  All others are checked on the whole sets before they link, and
components of links are duplicates.

Any order is right.  Shingles that are common in a sample of about ``sample``
documents come last, so that passages shared by many do not make pairs.

Defined results: shingles compare by XXH64 of their lower-case words; null and
empty texts are copies of each other; fewer words than a shingle are one
shingle; rows that repeat an id and text are one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.scratch import drop

from .common import connected_components, materialise, raw_texts, sliced, unique_ids, with_rid
from .simhash import hashes, links, vote
from .winnow import passes, repeated_filter


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(text, shingle)]))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(rid, s)``: the distinct shingles of each text, ascending as unsigned numbers."""
    schema = pa.schema([("rid", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([shingle_set(t, shingle).view(np.int64) for t in raw_texts(b)], pa.list_(pa.int64()))], schema=schema)

    return docs.select("rid", "text").mapInArrow(run, "rid long, s array<long>")


def _common(docs: DataFrame, shingle: int, sample: int, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``least`` or more of the sampled documents, and their counts."""
    share = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0)
    n = _sets(some, shingle).select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    got = n.orderBy(F.desc("n"), "h").limit(most).toArrow()  # ``most`` rows at most
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of the set ``s``, of which a similar set has one among its own first."""
    h, n = common
    rank = np.zeros(len(s), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        rank = np.where(h[at] == s, n[at], 0)
    return s[np.lexsort((s, rank))][: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


#: Ranges of hashes, by their upper bits, in which a sketch counts shingles.
RANGE_BITS = 7


def sketch(s: np.ndarray) -> bytes | None:
    """Numbers of the set's shingles in each range; none where one is over 255."""
    n = np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else None


def _profiles(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(rid, digest, fp, n, first, sketch)``: digest of the set, SimHash, size, prefix in the common order, and sketch."""
    schema = pa.schema([("rid", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("n", pa.int32()), ("first", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            digests, fps, sizes, firsts, sketches = [], [], [], [], []
            for t in raw_texts(b):
                chunks = list(hashes(t, shingle))
                s = np.unique(np.concatenate([np.zeros(0, np.uint64), *chunks]))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                fps.append(vote(chunks))
                sizes.append(len(s))
                firsts.append(prefix(s, common, similarity).view(np.int64))
                sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    return docs.select("rid", "text").mapInArrow(run, "rid long, digest binary, fp long, n int, first array<long>, sketch binary")


def least_shared(n: Column, m: Column, similarity: float) -> Column:
    """How many shingles sets of sizes ``n`` and ``m`` share at least if they are similar enough."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` that the sketches of ``nodes(rid, n, sketch)`` do not rule out."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.filter(pc.and_(pc.is_valid(b.column("a")), pc.is_valid(b.column("b"))))
            rest = b.filter(pc.or_(pc.is_null(b.column("a")), pc.is_null(b.column("b"))))
            x, y = (np.frombuffer(b"".join(known.column(c).to_pylist()), np.uint8).reshape(-1, 1 << RANGE_BITS) for c in ("a", "b"))
            ok = pa.array(np.minimum(x, y).sum(axis=1, dtype=np.int64) >= known.column("least").to_numpy())
            for part in (known.filter(ok), rest):
                yield pa.RecordBatch.from_arrays([part.column("src"), part.column("dst")], schema=schema)

    of = lambda c, s, n: nodes.select(F.col("rid").alias(c), F.col("sketch").alias(s), F.col("n").alias(n))
    both = pairs.join(of("src", "a", "n"), "src").join(of("dst", "b", "m"), "dst")
    return both.select("src", "dst", "a", "b", least_shared(F.col("n"), F.col("m"), similarity).cast("long").alias("least")).mapInArrow(run, "src long, dst long")


def _checked(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose whole sets are similar enough."""
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("rid")).distinct()
    s = materialise(_sets(docs.join(ids, "rid", "left_semi"), shingle), "sets")
    both = pairs.join(s.select(F.col("rid").alias("src"), F.col("s").alias("a")), "src").join(s.select(F.col("rid").alias("dst"), F.col("s").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    out = materialise(both.where(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("src", "dst"), "similar")
    drop(s)
    return out


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = connected_components(edges).select(F.col("u").alias("rid"), "label")
    return materialise(nodes.join(label, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "labelled")


def _of_several(nodes: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(rid, n, at, h)``: the prefixes of ``nodes(rid, n, first)`` by place, but for shingles that only one component has; a few of these may pass."""
    shared = nodes.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("first").flatten()
            size = pc.list_value_length(b.column("first")).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(passes(shared.value, flat.to_numpy().view(np.uint64)))
            of = pa.array(np.repeat(np.arange(b.num_rows), size)[ok])
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([b.column("rid").take(of), b.column("n").take(of), pa.array(at[ok].astype(np.int32)), flat.take(pa.array(ok))], schema=schema)

    return nodes.select("rid", "n", "first").mapInArrow(run, "rid long, n int, at int, h long")


def _met(rows: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(src, dst)`` of nodes in different components that share a shingle ``h`` early enough."""
    c = F.col
    both = rows.join(others.select("h", F.col("rid").alias("r"), F.col("n").alias("m"), F.col("at").alias("b"), F.col("label").alias("l")), "h").where("label <> l")
    enough = F.least(c("n") - c("at"), c("m") - c("b")) >= least_shared(c("n"), c("m"), similarity)
    return both.where(enough).select(F.least("rid", "r").alias("src"), F.greatest("rid", "r").alias("dst")).distinct()


def components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, sample: int = 20_000, rounds: int = 2) -> DataFrame:
    """``(rid, label)`` of one of the documents ``(rid, text)`` of each set of shingles, that with the smallest ``rid``; ``label`` is the smallest ``rid`` of its component."""
    p = materialise(_profiles(docs, shingle, similarity, _common(docs, shingle, sample)), "profiles")
    nodes = materialise(p.join(p.groupBy("digest").agg(F.min("rid").alias("rid")).select("rid"), "rid", "left_semi").select("rid", "fp", "n", "first", "sketch"), "nodes")
    drop(p)
    rep = materialise(nodes.groupBy("fp").agg(F.min("rid").alias("rep")), "reps")
    same = nodes.join(rep, "fp").where("rid <> rep").select(F.col("rep").alias("src"), F.col("rid").alias("dst"))
    a, b = (rep.select(F.col("fp").alias(c), F.col("rep").alias(f"r_{c}")) for c in ("src", "dst"))
    ball = links(rep.select("fp"), radius).join(a, "src").join(b, "dst").select(F.col("r_src").alias("src"), F.col("r_dst").alias("dst"))
    close = _checked(materialise(_possible(same.unionByName(ball), nodes, similarity), "ball"), docs, shingle, similarity)
    part = _labelled(nodes.select("rid"), close)
    of = nodes.select("rid", F.explode("first").alias("h")).join(part, "rid")
    met = of.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    first = materialise(_of_several(nodes, repeated_filter(met.select(F.col("h").alias("anchor"), F.lit(2).alias("n")))[0]), "firsts")
    for last in [False] * rounds + [True]:
        rows = materialise(first.join(part, "rid"), "met")
        others = rows
        if not last:
            meets = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("meets"))
            centre = rows.join(meets, "rid").groupBy("h").agg(F.max(F.struct("meets", (-F.col("rid")).alias("_r"), "rid", "n", "at", "label")).alias("c"))
            others = centre.select("h", "c.rid", "c.n", "c.at", "c.label")
        found = _checked(materialise(_possible(_met(rows, others, similarity), nodes, similarity), "pairs"), docs, shingle, similarity)
        close = close.unionByName(found)
        part = _labelled(nodes.select("rid"), close)
        drop(rows)
    return part


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their component; one of rows that repeat an id and text."""
    d = with_rid(docs, id_col, text_col, carry=True)
    if not unique_ids(docs, id_col):
        d = materialise(d.dropDuplicates(["rid"]), "once")
    kept = d.join(components(d.select("rid", "text"), shingle, similarity).where("rid = label").select("rid"), "rid", "left_semi")
    return kept.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
