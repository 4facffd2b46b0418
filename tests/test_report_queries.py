"""Queries of the report's relations against their SQL."""

import duckdb
import pytest

from siftline import queries, report_queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in queries.QUERIES.items() if n in queries.SQL and f.__module__ == report_queries.__name__)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "supplier", "nation", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_report_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(repr(tuple(r[at[c]] for c in columns)) for r in want.fetchall())


def test_there_are_some():
    assert len(NAMES) == 28
