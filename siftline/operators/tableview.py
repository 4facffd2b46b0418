"""The table operators of the report views: filter, search, sort, page, and marks of reported values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_text(df: DataFrame, text: str) -> DataFrame:
    """Rows in which some column's JSON text holds ``text``, without regard to case."""
    if not text:
        return df
    inside = [F.lower(F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":|\}$', ""), F.lit(""))).contains(text.lower()) for c in df.columns]
    found = inside[0]
    for x in inside[1:]:
        found = found | x
    return df.where(found)


def page(df: DataFrame, filters: dict[str, str] | None = None, search: str = "", order: list[Column] = (), number: int = 0, size: int = 500) -> DataFrame:
    """One page, counted from 0; ``order`` should be total."""
    for c, v in (filters or {}).items():
        if v:
            df = df.where(F.col(c).cast("string") == v)
    df = search_text(df, search)
    return (df.orderBy(*order) if order else df).offset(number * size).limit(size)


def by_locale(df: DataFrame, column: str, down: bool = False) -> Column:
    """The order of a column as a reader expects it: numbers by value, other values as text by the rules of Unicode.

    So letters with accents stand by those without, and small ones before the
    same large ones.  A null counts as empty text, first of all; lists count as
    their items joined by commas.
    """
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        key = c
    else:
        text = F.array_join(c.cast("array<string>"), ",", "") if kind.startswith("array") else c.cast("string")
        key = F.collate(F.coalesce(text, F.lit("")), "UNICODE")
    return key.desc() if down else key.asc()


def mark_reported(df: DataFrame, log: DataFrame, column: str) -> DataFrame:
    """Adds ``reported`` and the number of ``actions`` whose ``target`` is the row's value."""
    n = log.groupBy("target").agg(F.count(F.lit(1)).alias("actions"))
    return df.join(n, F.col(column) == F.col("target"), "left").withColumn("reported", F.col("target").isNotNull()).withColumn("actions", F.coalesce("actions", F.lit(0))).drop("target")


def actions_of(df: DataFrame, log: DataFrame, column: str) -> DataFrame:
    """Adds ``acted``: the actions ``(date, action, reference, status)`` whose ``target`` is the row's value, in the order of their dates."""
    by = log.groupBy(F.col("target").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("date", "action", "reference", "status"))).alias("acted"))
    return df.join(by, F.col(column) == F.col("_t"), "left").drop("_t").withColumn("acted", F.coalesce("acted", F.array()))


def bars(df: DataFrame, label: str, value: str, most: int = 8) -> DataFrame:
    """``(label, value)`` of the largest values, as a bar chart shows them; ties by label."""
    return df.select(F.col(label).alias("label"), F.col(value).alias("value")).orderBy(F.desc("value"), "label").limit(most)


def stacked(df: DataFrame, over: str, parts: list[str]) -> DataFrame:
    """``(over, part, value)``: the parts of each row of a stacked chart, from one column each."""
    return df.select(F.col(over), F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("value")) for p in parts])))


def pills(values: Column, most: int = 6) -> Column:
    """The first values, then how many more there are."""
    rest = F.size(values) - most
    return F.when(rest > 0, F.concat(F.slice(values, 1, most), F.array(F.concat(F.lit("+"), rest.cast("string"), F.lit(" more"))))).otherwise(values)
