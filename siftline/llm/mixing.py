"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, target size
over source size.  Documents of a source stand in the order of their size (ties
by a hash of the id), the running sum of expected copies is shifted by one
pseudo-random offset of the source, and a document is taken once for each whole
number that its own stretch of that sum crosses.  As neighbours in that order
are alike in size, the words taken come very near the target.

The running sum needs no source in one task: rows are range-partitioned by
source, size and hash, numbered inside their partition, and the offsets of the
(partition, source) pairs are added from a small aggregate.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are documents of their own, those of one id and
size in the order of a hash of their texts; an empty table gives
an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, source_size)``, one row per source.

    Water filling: with sources sorted by cap over weight, each one's level is what
    the earlier ones at their caps leave over, by weight.  Levels rise up to the
    first source that stays under its cap and fall after it, so the largest holds.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (((rank - 1) % len(weights)) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share
    s = s.withColumn("level", (total - before) / rest)
    top = F.max("level").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.select("source", "source_size", F.least(F.col("cap"), top * F.col("w")).cast("double").alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """``(doc_id, source, size, t, ...)`` as a copy: the range partitioner reads its input twice, and words are counted once."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("t"), *more)
    return materialise(d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "sizes")


def _copies(d: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str, *more: str) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken, ...)`` of the rows that :func:`_sized` returns; they hold no texts."""
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("h"), F.col("doc_id"), F.col("t")]
    d = materialise(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("i", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("i", 33)
    parts = d.groupBy("source", part.alias("part")).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    parts = materialise(parts, "mixparts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("source", "part", "first", ahead.alias("ahead"))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(F.col("p.source").alias("_s"), F.col("part").alias("_p"), "first", "ahead", "source_size", "target")
    d = d.join(parts, d["source"].eqNullSafe(parts["_s"]) & (part == parts["_p"]))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = (F.col("ahead") + F.col("i") - F.col("first")).cast("double")
    copies = (F.floor((at + 1) * each + u) - F.floor(at * each + u)).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies that a mixture takes of each document.

    ``share`` is the mixture's size over the size of all; ``most`` the largest
    target over a source's size.  Returns ``doc_id, source, size, source_size,
    target, copies, taken``.
    """
    return _copies(_sized(docs, id_col, text_col, source_col), weights, share, most, seed)


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row of ``docs`` as many times as it is taken, with the columns of ``docs``.

    Rows are numbered in a copy and ordered without their texts: in the order of
    size, the longest texts of a source would all stand in one range.  The number
    of copies is then joined to the texts, which are dealt evenly and not sorted.
    """
    d = _sized(docs, id_col, text_col, source_col, F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    taken = _copies(d.drop("row"), weights, share, most, seed, "at").where("copies > 0").select("at", F.col("copies").cast("int").alias("copies"))
    m = d.select("at", "row").join(taken.hint("shuffle_hash"), "at")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same mixture in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::BIGINT - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level FROM c),
g AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS each,
  ('0x' || substr(md5('mix|' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
  (row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id) - 1)::DOUBLE AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor((pos + 1) * each + u) - floor(pos * each + u) AS BIGINT) AS copies,
  CAST(floor((pos + 1) * each + u) - floor(pos * each + u) AS BIGINT) * size AS taken FROM p
"""
