"""Connected components, and the numbering of rows in an order, neither of which needs all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.scratch import drop, saved


def connected_components(edges: DataFrame, broadcast: bool = True) -> DataFrame:
    """``(u, label)`` for each node of ``edges(src, dst)`` with a neighbour: the smallest node of its component.

    Min-label hooking with pointer jumping: in each round a node, and the node
    it points to, take the least of what they and their neighbours point to, so
    chains shorten by jumps, not by single hops.  Rounds are joins and minimum
    aggregates with map-side combine; only the newest labels are kept.
    Without ``broadcast`` no table of a round passes the driver, however small.
    """
    side = (lambda d: d) if broadcast else (lambda d: d.hint("merge"))
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    e = saved(both.where("u <> v").distinct(), "edges")
    f = saved(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "labels")
    while True:
        g = f.join(side(f.select(F.col("u").alias("p"), F.col("p").alias("g"))), "p")
        near = e.join(side(g.select(F.col("u").alias("v"), "g")), "v").groupBy("u").agg(F.min("g").alias("m"))
        told = F.array(F.struct(F.col("u").alias("n"), F.least("p", "g", "m").alias("c"), F.col("p").alias("o")), F.struct(F.col("p").alias("n"), F.col("m").alias("c"), F.lit(None).cast("long").alias("o")))
        new = g.join(side(near), "u").select(F.inline(told)).groupBy("n").agg(F.min("c").alias("p"), F.max("o").alias("o"))
        new = saved(new.select(F.col("n").alias("u"), "p", "o"), "labels")
        changed = new.where("p <> o").limit(1).count()
        drop(f)
        f = new.select("u", "p")
        f.copied_to = new.copied_to
        if not changed:
            drop(e)
            return f.withColumnRenamed("p", "label")


def numbered(df: DataFrame, order: list[Column], name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with ``name``: each row's place in ``order``, counted from ``start``.

    Rows are sorted over all tasks and saved, counted by partition, and the
    counts of the partitions before are added.
    """
    at = "_place"
    d = saved(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(at, 33)
    counts = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    ahead = counts.select("_part", before.alias("_ahead"))
    out = d.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return out.withColumn(name, F.col("_ahead") + F.col(at).bitwiseAND((1 << 33) - 1) + start).select(*df.columns, name)
