"""Pages of a sorted table that read their own files only.

``write`` sorts a table once, over all tasks by ranges of its order, and writes
``rows/part=N`` with each row's place in its part, ``directory(part, first, n)``,
one row per part, and ``columns``, which has no rows.  ``page`` looks up in the directory which parts
hold a page's places, and reads these alone; so its cost is that of one or two
parts, whichever page it is and however large the table.

Defined results: a page beyond the end is empty, as is every page of an empty
table; nulls come first, and last in descending order; rows that are equal in
``order`` are in one part, in an order that is the same for every page, so an
``order`` that tells all rows apart also spares a part the copies of one key.  A
folder that is there already is an error; columns may have any name but ``part``
and ``_row``, which are refused.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIRECTORY = "part int, first long, n long"


def write(df: DataFrame, order: list[Column], folder: str, parts: int = 200) -> None:
    """Sort ``df`` into at most ``parts`` parts below ``folder``."""
    taken = {"part", "_row"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"column names that are taken: {', '.join(sorted(taken))}")
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place within the task's part
    placed.withColumns({"part": F.spark_partition_id(), "_row": row}).write.mode("error").partitionBy("part").parquet(f"{folder}/rows")
    df.limit(0).write.parquet(f"{folder}/columns")
    counts = df.sparkSession.read.schema("part int").parquet(f"{folder}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per part
    counts.select("part", F.coalesce(before, F.lit(0)).alias("first"), "n").coalesce(1).write.parquet(f"{folder}/directory")


def page(spark: SparkSession, folder: str, number: int, size: int = 500) -> DataFrame:
    """Page ``number``, counted from 0, in order."""
    known = sorted(tuple(r) for r in spark.read.schema(DIRECTORY).parquet(f"{folder}/directory").collect())  # at most ``parts`` rows
    at, end = number * size, (number + 1) * size
    firsts = [first for _, first, _ in known]
    mine = [(part, first) for part, first, n in known[max(0, bisect_right(firsts, at) - 1) :] if first < end and first + n > at]
    columns = spark.read.parquet(f"{folder}/columns")
    if not mine:
        return columns
    rows = spark.read.schema(T.StructType([*columns.schema.fields, T.StructField("_row", T.LongType()), T.StructField("part", T.IntegerType())])).option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/part={part}" for part, _ in mine])
    inside = F.lit(False)
    for part, first in mine:
        inside = inside | ((F.col("part") == part) & F.col("_row").between(at - first, end - first - 1))
    return rows.where(inside).orderBy("part", "_row").drop("_row", "part")
