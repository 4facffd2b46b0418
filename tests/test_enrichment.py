"""Enrichment, upserts, logs and sinks on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.plans import enrichment as E
from siftline.plans import report
from siftline.sources import tables as T


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_btc(spark):
    tx = lambda ins, outs, **status: json.dumps({"txid": "t", "status": status, "vin": [{"prevout": {"scriptpubkey_address": a, "value": v}} for a, v in ins], "vout": [{"scriptpubkey_address": a, "value": v} for a, v in outs]})
    given = [
        ("me", tx([("z", 5), ("a", 150_000_001), ("a", 1)], [("me", 150_000_000), ("z", 7)], confirmed=True, block_time=86_400, block_height=9)),
        ("me", tx([("me", 10)], [("b", 4), ("me", 5)])),
        ("me", tx([("me", 10)], [("me", 10), ("c", 0)])),
        ("me", json.dumps({"txid": "empty"})),
    ]
    got = [tuple(r) for r in E.btc_rows(spark.createDataFrame(given, "address string, payload string")).select("timestamp", "block_height", "direction", "amount", "counterparty_addresses", "confirmed").collect()]
    assert got == [
        ("1970-01-02T00:00:00Z", "9", "in", "1.50000000 BTC", "a; z", True),
        ("", "", "out", "0.00000005 BTC", "b", False),
        ("", "", "self", "0.00000000 BTC", "", False),
        ("", "", "self", "0.00000000 BTC", "", False),
    ]


def test_eth(spark):
    tx = lambda a, b, v, **more: json.dumps({"hash": "h", "from": a and {"hash": a}, "to": b and {"hash": b}, "value": v, "status": "ok"} | more)
    given = [("0xME", tx("0xA", "0xme", "1500000000000000000", block_number=3)), ("0xME", tx("0xMe", "0xme", "1")), ("0xME", tx("0xme", None, str(10**26))), ("0xME", tx(None, None, None, status="error"))]
    got = [tuple(r) for r in E.eth_rows(spark.createDataFrame(given, "address string, payload string")).select("direction", "amount", "counterparty_addresses", "confirmed", "block_height").collect()]
    assert got == [("in", "1.500000 ETH", "0xa", True, "3"), ("out", "0.000000 ETH", "0xme", True, ""), ("out", "100000000.000000 ETH", "", True, ""), ("self", "0.000000 ETH", "", False, "")]


def test_lookup_and_answers(spark):
    def client(keys):
        if "9.9.9.9" in keys:
            raise OSError("down")
        return [json.dumps({"query": k, "status": "fail" if k == "8.8.4.4" else "success", "as": "AS1 Net  One", "asname": "", "countryCode": "US"}) for k in keys]

    keys = spark.createDataFrame([("8.8.8.8",), ("8.8.4.4",), ("9.9.9.9",)], "ip string").repartition(1)
    got = E.look_up(keys, "ip", client, batch=1)
    assert rows(got, "ip", "error") == [("8.8.4.4", None), ("8.8.8.8", None), ("9.9.9.9", "OSError: down")]
    assert rows(E.ip_rows(got, "2024-01-01"), "ip", "asn", "as_name", "isp", "country_code", "checked_date") == [("8.8.8.8", "AS1", "Net  One", "", "US", "2024-01-01")]
    assert rows(E.status_row(got, "ip", ("OSError",)), "ip", "notes") == [("9.9.9.9", "lookup failed: OSError: down")]
    names = spark.range(1).select(E.nameserver_list(F.array(F.lit("B.x."), F.lit("a.x"), F.lit(""), F.lit("b.x"))).alias("n"), E.first_of(F.array().cast("array<string>")).alias("f"))
    assert rows(names, "n", "f") == [("a.x; b.x", "")]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "hand"), ("b", "2", "")], "k string, v string, notes string")
    new = spark.createDataFrame([("a", "", ""), ("c", "3", "x")], "k string, v string, notes string")
    assert rows(E.fill_in(old, new, "k"), "k", "v", "notes") == [("a", "1", "hand"), ("b", "2", ""), ("c", "3", "x")]
    assert rows(E.replace_rows(old, new, "k"), "k", "v", "notes") == [("a", "", "hand"), ("b", "2", ""), ("c", "3", "x")]
    assert rows(E.keep_candidates(old, new, "k"), "k") == [("a",)]
    assert rows(E.to_look_up(new, old, "k"), "k") == [("c",)] and rows(E.to_look_up(new, old, "k", recheck=True, limit=1), "k") == [("a",)]
    seen = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("a", "z", 2)], "k string, v string, seq long")
    assert rows(E.last_rows(seen, ["k"]), "k", "v", "seq") == [("a", "z", 0), ("b", "y", 1)]
    tx = lambda *r: spark.createDataFrame(r, "address string, txid string")
    checked = spark.createDataFrame([("w", "2"), ("idle", "0")], "address string, tx_count string")
    assert rows(E.replace_transactions(tx(("w", "1"), ("idle", "2"), ("x", "3")), tx(("w", "4"), ("w", "4")), checked), "address", "txid") == [("idle", "2"), ("w", "4"), ("x", "3")]


def test_logs(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert T.read_log(spark, path, "actions").count() == 0
    T.log_action(spark, path, "report", "domain", "a.b", date="2024-01-02")
    T.log_action(spark, path, "report", "ip", "1.2.3.4")
    with pytest.raises(ValueError, match="target type"):
        T.log_action(spark, path, "report", "planet", "x")
    assert rows(T.read_log(spark, path, "actions"), "seq", "target", "status") == [(0, "a.b", "submitted"), (1, "1.2.3.4", "submitted")]
    T.mark_triage(spark, path + "2", "abc")
    assert rows(T.read_log(spark, path + "2", "triage"), "id", "status") == [("abc", "reviewed")]


def test_csv(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    d = spark.createDataFrame([(["a", "b"], True, 'x "y"\nz', None)], "l array<string>, b boolean, s string, n string")
    T.write_csv(d, path)
    got = T.read_csv(spark, path, ["l", "b", "s", "n", "extra"])
    assert rows(got, "l", "b", "s", "n", "extra") == [("a; b", "True", 'x "y"\nz', "", "")] and rows(T.lists(got, ["l"]), "l") == [(["a", "b"],)]
    with pytest.raises(ValueError, match="unknown columns: n"):
        T.read_csv(spark, path, ["l", "b", "s"])
    assert T.read_csv(spark, path + "no", ["a"]).count() == 0


def test_document(spark, tmp_path):
    out = []
    d = spark.createDataFrame([(1, "é", None), (2, "b", [1])], "n long, s string, a array<long>")
    T.json_document({"total": 2, "x": (d, ["-n"]), "none": (d.where("n > 5"), [])}, out.append)
    assert json.loads("".join(out)) == {"total": 2, "x": [{"n": 2, "s": "b", "a": [1]}, {"n": 1, "s": "é", "a": None}], "none": []} and "é" in "".join(out)


def test_report(spark):
    from siftline import queries

    sf = "/root/testdata/sf0.001"
    m = queries.messages(spark, sf)
    empty = {n: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols)) for n, cols in T.SCHEMAS.items()}
    out = []
    T.json_document(report.document(m, empty, "2024-01-01T00:00:00Z"), out.append)
    got = json.loads("".join(out))
    assert list(got) == report.KEYS and got["message_total"] == m.count() == len(got["emails"]) and sum(got["category_counts"].values()) == got["message_total"]
    times = [x["times_seen"] for x in got["ips"]]
    assert times == sorted(times, reverse=True) and got["unenriched_ip_count"] == len(times)
    k = report.kpis(m, empty).first()
    assert k.messages == got["message_total"] and k.wallets == len(got["wallets"]) and k.active_wallets == 0 and k.untriaged == len(got["triage_queue"])
