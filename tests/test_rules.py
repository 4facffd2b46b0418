"""Small rules against the standard library."""

import email.utils

import pytest
from pyspark.sql import functions as F

from siftline.operators.triage import _literal
from siftline.plans import enrichment as E
from siftline.plans import messages as M

DATES = [
    "Mon, 01 Jan 24 10:00:00", "Mon, 01 Jan 2024 10:00:00 -0500", "01-Jan-24 10:00:00 GMT", "Monday, 01-Jan-24 10:00:00 GMT", "01-Jan-24", "01-Jan-24 10:00:00", "99 Jan 2024 10:00:00", "31 Feb 2024 10:00:00", "29 Feb 2024 10:00:00",
    "1 September 69 1:02", "1 Sep 68 1:02:03 GMT", "Jan 01 2024 10:00:00", "Sun, 31 Dec 2023 24:00:00 +0000", "Sun, 31 Dec 2023 23:59:59 +0000 (UTC)", "", "never", "2024-01-01", "Tue 02 Jan 2024 10:00:00 +0000", "5 Mai 2024 10:00:00", "Fri, 5 June 2020 10:00", "05 Juneau 2020 10:00:00",
]


def month(text):
    try:
        return email.utils.parsedate_to_datetime(text).strftime("%Y-%m")
    except Exception:  # noqa: BLE001
        return ""


def test_month_of_raw_dates(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(DATES)], "i int, date string")
    got = [r.m for r in d.select("i", M.month(F.lit(""), F.col("date")).alias("m")).orderBy("i").collect()]
    assert dict(zip(DATES, got)) == {x: month(x) for x in DATES}
    assert spark.range(1).select(M.month(F.lit("2023-05-06"), F.lit(DATES[0]))).first()[0] == "2023-05"


@pytest.mark.parametrize("text", ["act now", "act \\ now", "act\n\tnow\r", "it's", 'say "act"', "it's \"now\"", "act now​", "act\x01\x7f now", "é 😀 日 ", ""])
def test_literals(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(_literal(F.col("t"))).first()[0] == repr(text)


def test_only_a_rejected_request_is_final(spark):
    said = ["HTTPError: HTTP Error 400: Bad Request", "HTTPError: HTTP Error 500: at 400 ms", "HTTPError: HTTP Error 404: Not Found", "OSError: 400"]
    d = spark.createDataFrame([(f"BTC:{i}", None, x) for i, x in enumerate(said)], "wallet string, answer string, error string")
    assert [r.address for r in E.wallet_rows(d, "2024-01-01").collect()] == ["0"]
    assert [r.wallet for r in E.status_row(d, "wallet").collect()] == ["BTC:0"]
