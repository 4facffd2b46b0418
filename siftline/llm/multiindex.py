"""Nearest neighbours by largest inner product from an inverted multi-index.

Vectors are cut in two halves and each half has its own codebook, so a pair of
centroids names a cell.  A query scores each half's centroids by the largest
inner product a member of them can have: with the centroid, plus the query
half's norm times the radius.  A heap goes through the pairs by falling sum of
the two scores (rising distance).  A first round goes on until the cells hold ``probe`` vectors for
each query; their exact scores give a threshold, and a second round goes on as
long as a pair's bound reaches it.  As the sum bounds every inner product in a
cell, nothing that belongs to the result is missed with ``slack`` 1; with a
smaller one radii count less, and fewer cells are read at some loss of recall.

The codebooks are fitted on at most ``sample`` vectors, those with the smallest
hash of their id, and have about the square root of the number of vectors over
64 centroids each, 16 to 256; every vector is indexed.  Cells are packed into
blocks of about ``block_rows`` vectors, and large cells are split over several.
Queries are sent to the blocks they need.  A block that more than
``query_rows`` queries need is copied, once for each so many of them, and the
queries are dealt over its copies, so no task holds more than one of each at a
time, and vectors are only copied in proportion to the pairs of query and block.

Scores are sums of products in the order of the components, in double precision.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part (an inner product is defined
between equal lengths only); a query with no candidate has no row; ties go to
the smaller id; rows that repeat an id are one candidate, with its best score;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, in double precision."""
    v = F.col("v")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    d = d.where(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0))
    most = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("v") == (most["n"] if most else 0))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means, from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Index:
    """What a query needs to know of the index: centroids, and counts and radii of at most k * k cells."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], cells: list, block_rows: int, slack: float):
        self.books, self.half, self.slack = books, books[0].shape[1], slack
        self.rows = {r["cell"]: (r["n"], r["r1"], r["r2"]) for r in cells}
        k = len(books[1])
        self.reach = tuple(np.full(len(b), -1.0) for b in books)
        self.blocks: dict[int, tuple[int, int]] = {}
        at, filled = 0, 0
        for cell, (n, r1, r2) in sorted(self.rows.items()):
            for side, c, r in ((0, cell // k, r1), (1, cell % k, r2)):
                self.reach[side][c] = max(self.reach[side][c], r)
            parts = -(-n // block_rows)
            if filled and (parts > 1 or filled + n > block_rows):
                at, filled = at + 1, 0
            self.blocks[cell] = (at, parts)
            at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)

    def halves(self, v: np.ndarray) -> list[np.ndarray]:
        return [v[:, : self.half], v[:, self.half :]]

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Pairs' bounds in falling order, with the cell's own bound, the number of the cell."""
        scores, norms, orders = [], [], []
        for x, b, r in zip(self.halves(q[None, :]), self.books, self.reach):
            norms.append(float(np.linalg.norm(x)))
            dot = b @ x[0]
            s = np.where(r < 0, -np.inf, dot + self.slack * norms[-1] * r)
            o = np.argsort(-s, kind="stable")
            o = o[np.isfinite(s[o])]
            orders.append(o.tolist())
            scores.append((s[o].tolist(), dot[o].tolist()))
        (a, da), (b, db) = scores
        k = len(self.books[1])
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = orders[0][i] * k + orders[1][j]
            if cell in self.rows:
                _, r1, r2 = self.rows[cell]
                yield -bound, da[i] + db[j] + self.slack * (norms[0] * r1 + norms[1] * r2), cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def probe(self, q: np.ndarray, least: int) -> set[int]:
        """Blocks of the first cells that hold ``least`` vectors."""
        found, n = set(), 0
        for _, _, cell in self.cells(q):
            at, parts = self.blocks[cell]
            found.update(range(at, at + parts))
            n += self.rows[cell][0]
            if n >= least:
                break
        return found

    def above(self, q: np.ndarray, threshold: float) -> set[int]:
        """Blocks of all cells that can reach ``threshold``."""
        found = set()
        low = threshold - 1e-9 * (1 + abs(threshold))
        for bound, own, cell in self.cells(q):
            if bound < low:
                break
            if own >= low:
                at, parts = self.blocks[cell]
                found.update(range(at, at + parts))
        return found


def search(vectors: DataFrame, is_query: Column, k: int = 20, centroids: int | None = None, sample: int = 20_000, probe: int = 1_000, block_rows: int = 512, query_rows: int = 16_384, slack: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each row for which ``is_query`` holds over ``vec_id``, itself excepted."""
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # sample rows at most
    if not got.num_rows:
        return empty
    if centroids is None:
        centroids = min(256, max(16, round((v.count() / 64) ** 0.5)))
    x = _matrix(got.column("v").combine_chunks())
    half = max(1, x.shape[1] // 2)
    books = tuple(codebook(np.ascontiguousarray(h), centroids) for h in (x[:, :half], x[:, half:]))
    k2 = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"))
            near, radius = [], []
            for h, c in zip((m[:, :half], m[:, half:]), books):
                n = np.argmin((c * c).sum(axis=1)[None, :] - 2 * h @ c.T, axis=1)
                near.append(n)
                radius.append(np.linalg.norm(h - c[n], axis=1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array((near[0] * k2 + near[1]).astype(np.int32)), pa.array(radius[0]), pa.array(radius[1])], names=["vec_id", "v", "cell", "r1", "r2"])

    rows = materialise(v.mapInArrow(assign, "vec_id long, v array<double>, cell int, r1 double, r2 double"), "index")
    index = _Index(books, rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect(), block_rows, slack)  # centroids ** 2 rows at most
    known = spark.sparkContext.broadcast(index)
    plan = spark.createDataFrame([(c, a, n) for c, (a, n) in index.blocks.items()], "cell int, at int, parts int")
    block = (F.col("at") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    stored = rows.join(F.broadcast(plan), "cell").select("vec_id", "v", block.alias("block"))  # centroids ** 2 rows at most
    queries = materialise(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id"), "queries")
    tasks = 2 * spark.sparkContext.defaultParallelism

    def route(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, t = _matrix(b.column("q")), b.column("threshold").to_pylist()
                to = [known.value.probe(q, probe) for q in m]
                if second:
                    to = [known.value.above(q, x) - first for q, x, first in zip(m, t, to)]
                take = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("threshold").take(take), pa.array([x for s in to for x in sorted(s)], pa.int32())], names=["query_id", "threshold", "block"])

        return run

    hits = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hits.empty_table()
        q, m = (_matrix(t.column(c).combine_chunks()) for t, c in ((left, "q"), (right, "v")))
        qid, vid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        limit = left.column("threshold").to_numpy()
        by_id = np.argsort(vid, kind="stable")
        m, vid = m[by_id], vid[by_id]
        ids, starts = np.unique(vid, return_index=True)
        ends = np.r_[starts[1:], len(vid)]
        out: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(q), 256):
            s = np.maximum.reduceat(q[a : a + 256] @ m.T, starts, axis=1)  # rows that repeat an id, before the cut to k
            s[qid[a : a + 256, None] == ids[None, :]] = -np.inf
            least = -np.sort(-s, axis=1)[:, min(k, s.shape[1]) - 1]
            low = np.maximum(limit[a : a + 256], least)
            i, j = np.nonzero((s >= (low - 1e-9 * (1 + np.abs(low)))[:, None]) & np.isfinite(s))
            reps = (ends - starts)[j]
            row, col = np.repeat(i, reps), np.repeat(starts[j], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            exact = np.cumsum(q[a + row] * m[col], axis=1)[:, -1]
            best = np.maximum.reduceat(exact, np.cumsum(reps) - reps) if len(reps) else exact
            out.append((qid[a + i], ids[j], best))
        return pa.Table.from_arrays([pa.array(np.concatenate([x[n] for x in out])) for n in range(3)], schema=hits)

    def found(q: DataFrame, second: bool) -> DataFrame:
        """Hits of the blocks that each query is sent to."""
        routed = materialise(q.repartition(tasks, "query_id").mapInArrow(route(second), "query_id long, threshold double, block int"), "routes")
        copies = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("copies"))  # one row a block
        copies = materialise(copies, "copies")
        sent = routed.join(queries, "query_id").join(copies, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int"))
        held = stored.join(copies, "block").select("block", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
        return sent.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(score, "query_id long, vec_id long, score double")

    def ranked(d: DataFrame) -> DataFrame:
        d = d.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    lowest = F.lit(-1.7976931348623157e308)
    one = materialise(ranked(found(queries.withColumn("threshold", lowest), False)), "round1")
    limit = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    again = queries.join(limit, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("least")).otherwise(lowest).alias("threshold"))
    return ranked(one.select("query_id", "vec_id", "score").unionByName(found(again, True))).select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB SQL, with every pair of query and vector scored.
SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT len(v) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
u AS (SELECT vec_id, v FROM v WHERE len(v) = (SELECT n FROM n)),
q AS (SELECT vec_id AS query_id, min(v) AS q FROM u WHERE vec_id % 20 = 0 GROUP BY 1),
s AS (SELECT query_id, vec_id, max(list_inner_product(q, v)) AS score FROM q, u WHERE vec_id <> query_id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
