"""Mail queries against their SQL, and rules on single rows."""

import ipaddress
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline import queries
from siftline.functions import columns as C
from siftline.operators import tableview, templates
from siftline.operators.triage import triage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "supplier", "nation", "pages", "events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    clean = lambda d: [x.replace(".0,", ",").replace(".0]", "]") for x in rows(d)]
    assert clean(got) == clean(want)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize("address", ["8.8.8.8", "10.1.2.3", "100.64.0.1", "172.32.0.1", "172.16.0.1", "192.0.0.9", "192.0.0.8", "224.0.0.1", "240.0.0.1", "203.0.113.9"])
def test_global(spark, address):
    assert one(spark, C.is_global_ip(F.lit(address))) == ipaddress.ip_address(address).is_global


def test_bad_addresses(spark):
    assert not any(one(spark, C.is_global_ip(F.lit(a))) for a in ("8.8.8.256", "08.8.8.8", "8.8.8", "", "x"))


def test_defang(spark):
    assert one(spark, C.defang_url(F.lit("https://a.b/c.d?http://e.f"))) == "hxxps[://]a[.]b/c[.]d?hxxp[://]e[.]f"
    assert one(spark, C.defang_email(F.lit("a.b@c.d"))) == "a.b[@]c[.]d" and one(spark, C.defang_email(F.lit("plain"))) == "plain"
    assert one(spark, C.url_domain(F.lit("HTTP://User@A.com:80/x"))) == "user@a.com:80" and one(spark, C.url_domain(F.lit("/x"))) == ""


def test_brands_and_phrases(spark):
    assert one(spark, C.brands(F.lit("please verify your big new amazon account; SIGN UPS, irs"))) == ["Amazon", "IRS"]
    assert one(spark, C.display_brands(F.lit("PayPal Support"))) == ["PayPal"]
    assert one(spark, C.url_flags(F.array(F.lit("http://xn--a.com/"), F.lit("https://www.bit.ly/z")))) == ["punycode:xn--a.com", "shortener:www.bit.ly"]


def signal(spark, **changes):
    row = dict(from_domain="x.example", reply_domain="", dmarc="", spf="", dkim="", subject="", body="", display_name="", age=None, root_age=None, n_mismatch=0, n_wallets=0, flags=[], list_unsubscribe=False) | changes
    schema = "from_domain string, reply_domain string, dmarc string, spf string, dkim string, subject string, body string, display_name string, age int, root_age int, n_mismatch int, n_wallets int, flags array<string>, list_unsubscribe boolean"
    r = triage(spark.createDataFrame([tuple(row.values())], schema)).first()
    return r.category, r.scam_score, r.scam_signals


def test_triage(spark):
    assert signal(spark) == ("review", 0, []) and signal(spark, list_unsubscribe=True)[0] == "bulk_marketing"
    assert signal(spark, from_domain="a.substack.com", subject="urgent") == ("bulk_marketing", 0, ["known legit domain"])
    assert signal(spark, subject="verify your Amazon account")[2] == ["urgent keyword: 'verify your Amazon account'"]
    assert signal(spark, body="suspensão")[1] == 0  # accented words never match
    assert signal(spark, display_name="PayPal", from_domain="evil.example")[2] == ["display name claims PayPal, sent from evil.example"]
    assert signal(spark, dmarc="fail", spf="softfail", dkim="fail") == ("likely_scam", 4, ["dmarc=fail", "spf=softfail", "dkim=fail"])
    assert [signal(spark, age=a)[1] for a in (0, 89, 90, 364, 365)] == [3, 3, 1, 1, 0] and signal(spark, age=0, root_age=400)[1] == 0
    assert signal(spark, flags=["punycode:a", "shortener:b"])[1] == 2 and signal(spark, flags=["shortener:b"])[1] == 1


def test_clusters(spark):
    rng = random.Random(1)
    fp = {0: 0, 1: 0}
    for i in range(2, 60):
        fp[i] = fp[rng.randrange(2, i)] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4]))) if i > 2 and rng.random() < 0.6 else rng.getrandbits(64)
    label = {i: i for i in fp if fp[i]}
    for _ in range(60):
        for a in label:
            for b in label:
                if bin(fp[a] ^ fp[b]).count("1") <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    want = {}
    for i, x in label.items():
        want.setdefault(x, set()).add(i)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in fp.items()], "id long, fp long")
    got = {}
    for r in templates.clusters(df, "id").collect():
        got.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_search(spark):
    d = spark.createDataFrame([(1, "Foo"), (2, None)], "a long, b string")
    assert tableview.search_text(d, "fo").count() == 1 and tableview.search_text(d, '"').count() == 1 and tableview.search_text(d, "2").count() == 1
    assert one(spark, tableview.pills(F.sequence(F.lit(1), F.lit(8)).cast("array<string>"))) == ["1", "2", "3", "4", "5", "6", "+2 more"]
