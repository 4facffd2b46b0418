"""The suffix array of one long sequence by the difference-cover algorithm, sorted over all tasks.

The sampled suffixes, at places 1 and 2 modulo 3, are named by the order of
their triples of symbols; if names repeat, the sequence of names is sorted by
the same algorithm.  The others are sorted by their symbol and the rank of the
sampled suffix after it, and the two orders are merged: how many of one come
before each of the other follows from two sorts of both together, by symbol and
rank against places 1, by two symbols and rank against places 2.

Every step is a range-partitioned sort, a join on the place or a count, so no
task holds more than its range.  It costs some thirty passes over the rows:
``suffixes.deduplicate`` sorts stretches inside tasks instead, and the README
has the figures of both.

Defined results: symbols are numbers from 1; places are 0 to n - 1, each once;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.graph import numbered
from siftline.operators.scratch import drop

from .common import materialise


def _shifted(s: DataFrame, column: str, by: int, name: str) -> DataFrame:
    """``(pos, name)``: the value of ``column`` ``by`` places on."""
    return s.select((F.col("pos") - by).alias("pos"), F.col(column).alias(name))


def _or_zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]


def suffix_order(symbols: DataFrame) -> DataFrame:
    """``(pos, rank)``: the place of each suffix of ``symbols(pos, c)`` in their order, counted from 0."""
    s = materialise(symbols.select(F.col("pos").cast("long").alias("pos"), F.col("c").cast("long").alias("c")), "symbols")
    n = s.count()
    if n < 2:
        return s.select("pos", F.lit(0).cast("long").alias("rank"))
    ends = [s, s.sparkSession.createDataFrame([(n,)], "pos long").select("pos", F.lit(0).cast("long").alias("c"))] if n % 3 == 1 else [s]
    whole = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])  # a place 1 modulo 3 after the last place 0 modulo 3
    t = materialise(whole.join(_shifted(s, "c", 1, "c1"), "pos", "left").join(_shifted(s, "c", 2, "c2"), "pos", "left").select("pos", "c", *_or_zero("c1", "c2")), "triples")
    sample = t.where("pos % 3 <> 0")
    key = ["c", "c1", "c2"]
    named = numbered(sample.select(*key).distinct(), [F.col(k) for k in key], "name", 1)
    names = materialise(sample.join(named, key).select("pos", "name"), "names")
    m, different = names.count(), names.agg(F.max("name")).first()[0]
    if different < m:
        ones = names.where("pos % 3 = 1").count()
        place = F.when(F.col("pos") % 3 == 1, (F.col("pos") - 1) / 3).otherwise((F.col("pos") - 2) / 3 + ones).cast("long")
        inner = suffix_order(names.select(place.alias("pos"), F.col("name").alias("c")))
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        r = inner.select(back.alias("pos"), (F.col("rank") + 1).alias("r"))
    else:
        r = names.select("pos", F.col("name").alias("r"))
    r = materialise(r, "ranks")
    drop(names)
    d = t.join(_shifted(r, "r", 0, "r0"), "pos", "left").join(_shifted(r, "r", 1, "r1"), "pos", "left").join(_shifted(r, "r", 2, "r2"), "pos", "left")
    d = materialise(d.select("pos", "c", "c1", *_or_zero("r0", "r1", "r2")), "ranked")

    def before(modulus: int, keys: list[str]) -> DataFrame:
        """``(pos, n)``: for places 0 modulo 3, how many suffixes of ``modulus`` come before; for those, how many of places 0 modulo 3."""
        both = numbered(d.where(F.col("pos") % 3 == modulus).unionByName(d.where("pos % 3 = 0")).select("pos", *keys), [F.col(k) for k in keys], "both")
        own = numbered(both.where(F.col("pos") % 3 == modulus).select("pos", "both"), [F.col("both")], "own").unionByName(numbered(both.where("pos % 3 = 0").select("pos", "both"), [F.col("both")], "own"))
        return own.select("pos", (F.col("both") - F.col("own")).alias("n"), "own")

    one, two = materialise(before(1, ["c", "r1"]), "one"), materialise(before(2, ["c", "c1", "r2"]), "two")
    zero = one.where("pos % 3 = 0").join(two.select("pos", F.col("n").alias("n2")), "pos").select("pos", (F.col("own") + F.col("n") + F.col("n2")).alias("rank"))
    others = one.where("pos % 3 <> 0").unionByName(two.where("pos % 3 <> 0")).join(r, "pos").select("pos", (F.col("n") + F.col("r") - 1).alias("rank"))
    out = materialise(zero.unionByName(others), "order")
    for copy in (s, t, r, d, one, two):
        drop(copy)
    if len(ends) > 1:  # the place added at the end is the least suffix of all
        return out.where(F.col("pos") < n).select("pos", (F.col("rank") - 1).alias("rank"))
    return out


def _runs(ordered: DataFrame) -> DataFrame:
    """``(rid, start, run)`` of ``(rid, start, rank, prefix)``: neighbours in the order of ``rank`` with one prefix share a run.

    Each task compares the neighbours of its range; the last row of each range
    is handed to the next, and runs are counted on from range to range.
    """
    d = materialise(ordered.orderBy("rank").withColumn("part", F.spark_partition_id()), "sorted")
    inside = W.partitionBy("part").orderBy("rank")
    last = d.groupBy("part").agg(F.max_by("prefix", "rank").alias("last"))  # one row a range
    handed = last.select("part", F.lag("last").over(W.orderBy("part")).alias("handed"))
    before = F.coalesce(F.lag("prefix").over(inside), F.col("handed"))
    d = d.join(F.broadcast(handed), "part").withColumn("new", F.when(before == F.col("prefix"), 0).otherwise(1))
    d = materialise(d.select("rid", "start", "part", F.sum("new").over(inside).alias("run")), "runs")
    ends = d.groupBy("part").agg(F.max("run").alias("n"))
    ahead = ends.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return d.join(F.broadcast(ahead), "part").select("rid", "start", (F.col("run") + F.col("ahead")).alias("run"))


def repeated_starts(texts: DataFrame, length: int = 50) -> DataFrame:
    """``(rid, start, least)``: every string of ``length`` bytes of ``texts(rid, text)``, with the smallest ``rid`` that has it.

    Texts lie end to end, each closed by a number of its own, so no string
    crosses them.  Neighbours in the order are compared over ``length`` bytes,
    and a run of equal ones has the least ``rid`` of its rows.  A null text is
    empty; rows of one ``rid`` are texts of their own that count as one document.
    """
    t = materialise(numbered(texts.select("rid", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")), [F.col("rid"), F.col("b")], "k"), "texts")
    bytes_ = t.select("rid", "k", F.posexplode(F.sequence(F.lit(0), F.octet_length("b"))).alias("start", "_x"), "b")
    value = F.when(F.col("start") < F.octet_length("b"), F.conv(F.hex(F.expr("substring(b, start + 1, 1)")), 16, 10).cast("long") + 1).otherwise(F.col("k") + 257)
    s = materialise(numbered(bytes_.select("rid", "k", "start", value.alias("c")), [F.col("k"), F.col("start")], "pos"), "bytes")
    order = suffix_order(s.select("pos", "c"))
    placed = s.join(order, "pos").select(F.col("k").alias("_k"), F.col("start").alias("_s"), "rank")
    prefix = bytes_.where(F.col("start") <= F.octet_length("b") - length).select("rid", "k", "start", F.expr(f"substring(b, start + 1, {length})").alias("prefix"))
    ordered = prefix.join(placed, (F.col("k") == F.col("_k")) & (F.col("start") == F.col("_s"))).select("rid", "start", "rank", "prefix")
    runs = materialise(_runs(ordered), "numbered")
    return runs.join(runs.groupBy("run").agg(F.min("rid").alias("least")), "run").select("rid", "start", "least")
