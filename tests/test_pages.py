"""Pages of sorted copies, and the order of text by locale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline import queries
from siftline.operators import pages, tableview

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sorted_page", "names_by_locale"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name].replace("OFFSET 5000", "OFFSET 100"))
    at = {c[0]: i for i, c in enumerate(want.description)}
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(at)
    if name == "names_by_locale":
        assert sorted(map(repr, map(tuple, got.select(*at).collect()))) == sorted(repr(tuple(r)) for r in want.fetchall())


def test_pages_are_those_of_the_whole_order(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    d = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 > 3, F.col("id") % 7).alias("v"), F.lit("x").alias("first"), F.lit("y").alias("n"))
    order = [F.desc("v"), F.col("id")]
    pages.write(d, order, folder, parts=6)
    want = [tuple(r) for r in d.orderBy(*order).collect()]
    for size in (1, 37, 500, 5000):
        for number in {0, 1, 3, 1000 // size, 1000 // size + 1, 10**9}:
            if number < 30:
                assert [tuple(r) for r in pages.page(spark, folder, number, size).collect()] == want[number * size : (number + 1) * size]
    one = pages.page(spark, folder, 80, 10)
    files = one.inputFiles()
    parts = spark.read.parquet(f"{folder}/directory").count()
    assert parts > 3 and len({f.rpartition("/")[0] for f in files}) <= 2 and one.columns == d.columns
    assert [tuple(r) for r in one.collect()] == want[800:810] and pages.page(spark, folder, 10**12).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        pages.write(d, order, folder)
    with pytest.raises(ValueError, match="taken: part"):
        pages.write(d.withColumn("Part", F.lit(1)), order, f"{folder}2")


def test_ties_and_no_rows(spark, tmp_path):
    d = spark.range(300).select("id", (F.col("id") % 2).alias("v"))
    pages.write(d, [F.col("v")], f"file://{tmp_path}/t", parts=8)
    got = [r.id for n in range(7) for r in pages.page(spark, f"file://{tmp_path}/t", n, 50).collect()]
    assert sorted(got) == list(range(300)) and all(x % 2 == 0 for x in got[:150])
    pages.write(d.limit(0), [F.col("v")], f"file://{tmp_path}/e")
    empty = pages.page(spark, f"file://{tmp_path}/e", 0)
    assert empty.columns == ["id", "v"] and empty.count() == 0


def test_order_by_locale(spark):
    """A list written by hand: case and accents matter only between equal letters."""
    names = [None, "", "10", "9", "a", "A", "à", "Ab", "äc", "b", "Émile", "emilia", "Z", "zoë", "Zoe2"]
    d = spark.createDataFrame([(x, len(names) - i) for i, x in enumerate(names)], "name string, i int")
    got = [r.name for r in d.orderBy(tableview.by_locale(d, "name"), F.desc("i")).collect()]
    assert got == names
    assert [r.name for r in d.orderBy(tableview.by_locale(d, "name", down=True), "i").collect()] == names[::-1]
    n = spark.createDataFrame([(10.0, ["b"]), (9.0, ["a", "z"]), (None, ["a"]), (-1.0, None)], "v double, l array<string>")
    assert [r.v for r in n.orderBy(tableview.by_locale(n, "v")).collect()] == [None, -1.0, 9.0, 10.0]
    assert [r.l for r in n.orderBy(tableview.by_locale(n, "l")).collect()] == [None, ["a"], ["a", "z"], ["b"]]
