"""Mail files from end to end: parsed, stored, reported, with every value worked out by hand."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.operators import templates
from siftline.plans import enrichment as E
from siftline.plans import messages as M
from siftline.plans import report
from siftline.plans.store import Store, publish, self_addresses
from siftline.sources import files, mail, tables

BTC, ETH = "bc1" + "q" * 30, "0x" + "aB" * 20
PNG = base64.b64encode(b"not really a picture").decode()


def eml(body="body", kind="text/plain; charset=utf-8", **headers):
    h = {"From": "a@x.example", "Subject": "hi", "Date": "Mon, 01 Jan 2024 10:00:00 +0000", "Content-Type": kind} | {k.replace("_", "-"): v for k, v in headers.items()}
    return ("".join(f"{k}: {v}\n" for k, v in h.items() if v is not None) + "\n" + body + "\n").encode()


def parts(*bodies):
    return "\n".join(f"--B\nContent-Type: {kind}\n\n{text}" for kind, text in bodies) + "\n--B--\n"


MAILS = {
    "M01a": eml(Date="Mon, 01 Jan 2024 10:00:00 +0000"),
    "M01b": eml(Date="Tue, 02 Jan 2024 10:00:00 +0000"),
    "M02a": eml(Message_ID="<same@x>"),
    "M02b": eml(Message_ID="\n <same@x>  "),
    "M03": eml(From='"PayPal" <p@evil.example>', Message_ID="<3>"),
    "M04": eml(From="a@x.example", Reply_To="me@mail.yahoo.com", Message_ID="<4>"),
    "M05": eml(Authentication_Results="mx; dkim=fail; spf=softfail; dmarc=fail", Message_ID="<5>"),
    "M06": eml("urgent, act now", From="n@news.substack.com", Message_ID="<6>"),
    "M07a": eml(Message_ID="<7a>", List_Unsubscribe="<mailto:u@x>"),
    "M07b": eml(Message_ID="<7b>"),
    "M08": eml("please verify your Amazon account today", Message_ID="<8>"),
    "M09": eml("suspensão", Message_ID="<9>"),
    "M10": eml('<a href="http://evil.top/x">see <b>paypal.com</b></a> <a href="http://p.com">pay<b>pal</b>.com</a>', "text/html", Message_ID="<10>"),
    "M11": eml('<div style="display:none">one<div>two</div>three</div>four<div style="opacity:0"><div style="font-size:0px">five</div>six</div>seven', "text/html", Message_ID="<11>"),
    "M12": eml("write to bob (at) shop (dot) com or pаul​@shop.org", Message_ID="<12>"),
    "M13": eml("+ 1 (656) 556 - 2194, order 123456789012, call 223456789012", Message_ID="<13>"),
    "M14": eml("call +1 656\n555 1234", Message_ID="<14>"),
    "M15": eml("contact a@b.co c@d.co e@f.co g@h.co", Message_ID="<15>"),
    "M16": eml(Received="from [10.0.0.1] by ([8.8.8.8]) id 15.21.245.11", Message_ID="<16>"),
    "M17a": eml("dear friend your prize waits at http://a.example/1 so call +1 656 555 1234", Message_ID="<17a>"),
    "M17b": eml(f"dear friend your prize waits at http://b.example/2 so call +1 656 555 9999 {BTC}", Message_ID="<17b>", From="z@other.example"),
    "M19": eml(f"send to {BTC} or {ETH} or 1{'A' * 30}", Message_ID="<19>"),
    "M20": eml("http://xn--pypal-4ve.com/a https://www.bit.ly/x", Message_ID="<20>"),
    "M22": eml(Date="never", Message_ID="<22>"),
    "M23": eml(parts(("text/plain", "pictures"), (f'image/png; name="one.png"\nContent-Transfer-Encoding: base64', PNG), (f'application/x; name="two.JPG"\nContent-Transfer-Encoding: base64', PNG)), 'multipart/mixed; boundary="B"', Message_ID="<23>"),
    "M25": eml('<a href="/rel">x</a><a href="mailto:q@x">m</a>', "text/html", Message_ID="<25>"),
    "M26": eml("plain words in odd type, urgent", "application/octet-stream", Message_ID="<26>"),
    "M27": eml("bank holiday in north america", From='"Bank holiday of North America" <b@x.example>', Message_ID="<27>"),
    "M28": eml("hello", From='"AARP and Aflac" <b@x.example>', Message_ID="<28>"),
    "M29": eml("please act now or now", Message_ID="<29>"),
    "M30": eml("hello friend", From='"Netflix" <b@netflix.com>', Message_ID="<30>"),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("mail") / "in"
    (top / "box").mkdir(parents=True)
    for name, raw in MAILS.items():
        (top / f"{name}.eml").write_bytes(raw)
    return top


@pytest.fixture(scope="module")
def rows(spark, root):
    return {r.path.rpartition("/")[2][:-4]: r for r in mail.signals(mail.read_mail(spark, str(root)), ["own@x.example"]).collect()}


def verdict(r):
    return r.category, r.scam_score, r.scam_signals


def test_ids(rows):
    assert rows["M01a"].id != rows["M01b"].id and rows["M02a"].id == rows["M02b"].id


def test_verdicts(rows):
    assert verdict(rows["M03"]) == ("likely_scam", 3, ["display name claims PayPal, sent from evil.example"])
    assert verdict(rows["M04"]) == ("review", 2, ["reply-to diverted to freemail (mail.yahoo.com)"])
    assert verdict(rows["M05"]) == ("likely_scam", 4, ["dmarc=fail", "spf=softfail", "dkim=fail"])
    assert verdict(rows["M06"]) == ("bulk_marketing", 0, ["known legit domain"])
    assert verdict(rows["M07a"]) == ("bulk_marketing", 0, []) and verdict(rows["M07b"]) == ("review", 0, [])
    assert verdict(rows["M08"]) == ("likely_scam", 3, ["urgent keyword: 'verify your Amazon account'"])
    assert verdict(rows["M09"])[1] == 0
    assert verdict(rows["M20"]) == ("review", 2, ["punycode (IDN look-alike) domain in URL"])
    assert verdict(rows["M26"]) == ("likely_scam", 3, ["urgent keyword: 'urgent'"])
    assert verdict(rows["M27"])[1] == 0
    assert verdict(rows["M28"]) == ("likely_scam", 3, ["display name claims AARP, sent from x.example"])
    assert verdict(rows["M29"])[2] == ["urgent keyword: 'act now'"]
    assert verdict(rows["M30"])[1] == 0 and rows["M30"].impersonated_brands == ["Netflix"]


def test_bodies(rows):
    assert rows["M10"].link_mismatches == ["paypal.com => evil.top"]
    assert rows["M11"].body.replace("\n", "") == "threefourseven"
    assert rows["M12"].contact_emails == ["bob@shop.com", "paul@shop.org"]
    assert rows["M13"].phones == ["1 (656) 556 - 2194", "223456789012"]
    assert rows["M14"].phones == ["+1 656 555 1234"] and rows["M14"].phones_functional == [] and rows["M14"].phones_filler == ["+1 656 555 1234"]
    assert rows["M15"].contacts_functional == [] and rows["M15"].contacts_filler == ["a@b.co", "c@d.co", "e@f.co", "g@h.co"]
    assert rows["M16"].originating_ips == ["8.8.8.8"]
    assert rows["M17a"].body_template_fingerprint == rows["M17b"].body_template_fingerprint != "0" * 16
    assert (rows["M19"].btc_addresses, rows["M19"].eth_addresses) == ([BTC, "1" + "A" * 30], [ETH])
    assert rows["M22"].date_iso == ""
    assert [(x.name, x.size, x.type) for x in rows["M23"].images] == [("one.png", 20, "image/png"), ("two.JPG", 20, "application/x")] and len({x.hash for x in rows["M23"].images}) == 1
    assert rows["M25"].urls == ["/rel"]


def test_fingerprint_is_that_of_the_native_operator(spark, rows):
    texts = [(n, r.body) for n, r in rows.items() if r.body.isascii()]
    got = {r.n: r.fp for r in templates.fingerprints(spark.createDataFrame(texts, "n string, body string"), "n", F.col("body")).collect()}
    assert {n: x % (1 << 64) for n, x in got.items()} == {n: parsing.template_fingerprint(t) for n, t in texts}


def test_messages_as_text(spark, rows, root):
    """The table of 39 columns is the same from mail and from its text form."""
    typed = M.from_signals(mail.signals(mail.read_mail(spark, str(root)))).select(*M.COLUMNS)
    assert len(M.COLUMNS) == 39
    text = tables.flat(typed)
    back = M.from_text(text).select(*M.COLUMNS)
    assert sorted(map(str, back.collect())) == sorted(map(str, typed.collect()))
    by = {r.id: r for r in typed.collect()}
    m = by[rows["M20"].id]
    assert (m.url_count, m.url_domains, m.first_url, m.url_flags) == (2, ["www.bit.ly", "xn--pypal-4ve.com"], "http://xn--pypal-4ve.com/a", ["punycode:xn--pypal-4ve.com", "shortener:www.bit.ly"])
    m = by[rows["M23"].id]
    assert (m.image_count, m.image_filenames, m.image_phashes, m.image_ocr_chars) == (2, ["one.png", "two.JPG"], [], 0)


def test_month(spark):
    d = spark.createDataFrame([("2024-05-06", ""), ("", "Mon, 01 Jan 2024 23:30:00 -0500"), ("", "never"), (None, "3 Feb 2021 1:02 GMT"), ("", "2021-01-01")], "date_iso string, date string")
    assert [r.x for r in d.select(M.month(F.col("date_iso"), F.col("date")).alias("x")).collect()] == ["2024-05", "2024-01", "", "2021-02", ""]


def test_images_are_paired_by_place(spark):
    """A likeness that is blank is left out of the table, so the next one moves to its image."""
    d = spark.createDataFrame([(0, "i", "s", "d.example", ["h1", "h2"], ["p2"], ["n1", "n2"])], "seq long, id string, subject string, from_domain string, image_hashes array<string>, image_phashes array<string>, image_filenames array<string>")
    assert [(r.hash, r.phash, r.filenames) for r in report.images(d).orderBy("hash").collect()] == [("h1", "p2", ["n1"]), ("h2", "", ["n2"])]


def test_mailbox_in_splits(spark, tmp_path):
    """A mailbox is read the same however it is cut, with junk before its first message and a line end of either kind."""
    (tmp_path / "in").mkdir()
    raw = b"junk\n\n" + b"".join(b"From someone %d\r\n" % i + eml(f"number {i} " + "x" * (i * 37 % 500), Message_ID=f"<{i}>") + b"\n" for i in range(300))
    (tmp_path / "in" / "a.mbox").write_bytes(raw)
    (tmp_path / "in" / "B.MBOX").write_bytes(raw[6:])
    want = [f"<{i}>" for i in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = mail.read_mail(spark, str(tmp_path / "in"))
            assert size == "128m" or got.rdd.getNumPartitions() > 20
            for name in ("a.mbox", "B.MBOX"):
                assert [r.message_id for r in got.where(F.col("path").endswith(name)).orderBy("position").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_own_addresses(tmp_path):
    (tmp_path / "own.txt").write_text("# mine\nMe@X.example  # work\n\nb@y.example\n")
    assert self_addresses(str(tmp_path / "own.txt")) == ["me@x.example", "b@y.example"]


def test_store(spark, root, tmp_path):
    """Ingest twice, look up, report: the whole document and the sheets."""

    def ip_answers(keys):
        return [json.dumps({"query": k, "status": "success", "as": "AS15169 Google LLC", "asname": "GOOGLE", "isp": "Google", "country": "United States", "countryCode": "US"}) for k in keys]

    store = Store(spark, f"file://{tmp_path}/store")
    run = {r.category: r.messages for r in store.ingest(str(root)).collect()}
    assert run["files"] == len(MAILS) and run["duplicates"] == 1 and run["unreadable"] == 0
    total = sum(run.get(c, 0) for c in ("likely_scam", "review", "bulk_marketing"))
    assert total == len(MAILS) - 1
    again = {r.category: r.messages for r in store.ingest(str(root)).collect()}
    assert again == {"files": len(MAILS), "duplicates": len(MAILS), "unreadable": 0}
    m = store.messages()
    assert m.count() == total and m.select("seq").distinct().count() == total
    paths = [r.id for r in m.orderBy("seq").collect()]
    assert paths[0] == mail.signals(mail.read_mail(spark, str(root))).where(F.col("path").endswith("M01a.eml")).first().id
    assert store.look_up_ips(ip_answers, "2024-01-02", delay=0) == 1 and store.look_up_ips(ip_answers, "2024-01-02", delay=0) == 0

    def whois(domain):
        if domain == "x.example":
            return {"creation_date": "2024-01-01", "registrar": ["R", "S"], "name_servers": ["NS1.h.net.", "ns1.h.net"], "org": None, "country": "US"}
        raise LookupError(domain)

    from siftline.sources.explorers import domain_client

    assert store.look_up_domains(domain_client(whois), at_least=2, delay=0) == 1
    out = []
    store.document(out.append, "now")
    doc = json.loads("".join(out))
    assert list(doc) == report.KEYS and doc["message_total"] == total and sum(doc["category_counts"].values()) == total and doc["unenriched_ip_count"] == 0
    assert doc["ips"] == [{"ip": "8[.]8[.]8[.]8", "times_seen": 1, "distinct_domains": 1, "asn": "AS15169", "as_name": "GOOGLE", "isp": "Google", "country": "United States", "artifact": False, "sample_subjects": ["hi"], "sample_ids": doc["ips"][0]["sample_ids"]}]
    assert [(x["asn"], x["countries"], x["messages"]) for x in doc["asns"]] == [("AS15169", ["US"], 1)]
    d = doc["domains"][0]
    assert (d["domain"], d["registered"], d["registrar"], d["nameservers"], d["registrant_country"], d["enriched"], d["is_freemail_address"]) == ("x[.]example", "2024-01-01", "R", ["ns1[.]h[.]net"], "US", True, False)
    assert d["count"] == sum(b"@x.example" in x.split(b"\n\n")[0] for x in MAILS.values()) - 1 and len(d["sample_subjects"]) == 4 and len(d["sample_ids"]) == 6
    assert [(x["count"], x["distinct_domains"], x["contacts"]) for x in doc["template_clusters"] if x["contacts"]] == [(2, 2, ["+1 656 555 1234", "+1 656 555 9999"])]
    assert [(x["type"], x["value"], x["confidence"], x["domain_count"], x["domains"]) for x in doc["fingerprints"]] == [("BTC", BTC, "wallet", 2, ["other[.]example", "x[.]example"])]
    assert [(x["brand"], x["count"]) for x in doc["brands"]] == [("PayPal", 2), ("Amazon", 1), ("Bank of America", 1), ("AARP", 1), ("Aflac", 1), ("Netflix", 1)]
    assert doc["brands"][0] == {"brand": "PayPal", "count": 2, "categories": ["likely_scam", "review"], "distinct_domains": 2, "sample_subjects": ["hi", "hi"], "sample_ids": doc["brands"][0]["sample_ids"]}
    assert [x["month"] for x in doc["trends"]] == ["(unknown)", "2024-01"] and doc["trends"][1]["top_brands"][0] == {"brand": "PayPal", "count": 2}
    assert {x["value"]: x["confidence"] for x in doc["phones"]}["+1 656 555 1234"] == "functional" and doc["phones"][0]["confidence"] == "functional"
    assert {x["value"]: x["confidence"] for x in doc["contact_emails"]}["bob[@]shop[.]com"] == "functional"
    assert [(x["times_seen"], x["filenames"]) for x in doc["images"]] == [(2, ["one.png", "two.JPG"])]
    assert {(x["url"], x["domain"]) for x in doc["urls"]} >= {("/rel", ""), ("hxxps[://]www[.]bit[.]ly/x", "www[.]bit[.]ly")} and list(doc["urls"][0]) == ["id", "url", "domain"]
    assert len(doc["emails"]) == total and len(doc["emails"][0]) == 25
    assert list(doc["emails"][0])[:6] == ["id", "source", "category", "scam_score", "scam_signals", "date"]
    scores = [(x["scam_score"], x["date"]) for x in doc["triage_queue"]]
    assert [s for s, _ in scores] == sorted((s for s, _ in scores), reverse=True) and len(scores) == total - doc["category_counts"]["bulk_marketing"]
    assert {(x["chain"], x["address"], x["times_seen"], x["active"]) for x in doc["wallets"]} == {("BTC", BTC, 2, False), ("BTC", "1" + "A" * 30, 1, False), ("ETH", ETH, 1, False)}

    store.sheets(f"file://{tmp_path}/sheets")
    sheet = lambda n: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/sheets/{n}")
    assert all(sheet(n).columns == c for n, c in report.SHEETS.items()) and len(report.SHEETS) == 19
    clusters = sheet("Domain Clusters").collect()
    assert clusters[0].domain == "x.example" and clusters[0].registered == "2024-01-01" and clusters[0].sample_subjects == "hi | hi | hi | hi"
    summary = {(r.part, r.name): r["count"] for r in sheet("Summary").collect()}
    assert summary["total", "operator fingerprints"] == "1" and summary["brand", "PayPal"] == "2" and summary["category", "likely_scam"] == str(doc["category_counts"]["likely_scam"])
    assert sheet("Emails").count() == total and sheet("IP Addresses").first().ip == "8.8.8.8"


def test_publish(spark, root, tmp_path):
    from siftline.sources.explorers import wallet_client

    def get(url):
        if "/api/v2/" in url:
            raise OSError("down")
        if url.endswith("/txs"):
            return [{"txid": "t1", "status": {"confirmed": True, "block_time": 86400, "block_height": 5}, "vin": [{"prevout": {"scriptpubkey_address": "payer", "value": 7}}], "vout": [{"scriptpubkey_address": BTC, "value": 7}]}]
        return {"chain_stats": {"tx_count": int(url.endswith(BTC)), "funded_txo_sum": 7, "spent_txo_sum": 0}}

    store = Store(spark, f"file://{tmp_path}/store")
    said = publish(store, str(root), str(tmp_path / "out" / "data.json"), {"wallets": wallet_client(get, pause=0), "ips": lambda keys: 1 / 0}, "2024-01-02")
    assert said == {"ingest": "done", "ips": "done", "domains": "skipped", "wallets": "done", "report": "done"}
    doc = json.loads((tmp_path / "out" / "data.json").read_text())
    w = {x["address"]: x for x in doc["wallets"]}
    assert w[BTC]["active"] and w[BTC]["total_received"] == "0.00000007 BTC" and w[BTC]["first_seen"] == w[BTC]["last_seen"] == "1970-01-02" and w[ETH]["checked_date"] == ""
    assert doc["wallet_transactions"] == [{"address": BTC, "chain": "BTC", "txid": "t1", "timestamp": "1970-01-02T00:00:00Z", "direction": "in", "amount": "0.00000007 BTC", "counterparty_addresses": ["payer"], "confirmed": "True", "explorer_url": "https://blockstream.info/tx/t1"}]


def test_ages_reach_the_rules(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("domain_enrichment", spark.sql("SELECT 'x.example' AS domain, cast(date_sub(current_date(), 0) AS string) AS registered_date, 'R' AS registrar"))
    store.ingest(str(root))
    plain = store.messages().where("date = 'Tue, 02 Jan 2024 10:00:00 +0000'").first()
    assert (plain.scam_score, plain.scam_signals) == (3, ["sender domain registered 0 days ago"])


def test_archive(spark, tmp_path):
    import zipfile

    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    (top / "sub" / "a.eml").write_bytes(MAILS["M03"])
    (top / "other.txt").write_text("stays")
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(f"file://{top}", archive=f"file://{tmp_path}/scanned", day="2024-01-02")
    (top / "sub" / "a.eml").write_bytes(MAILS["M04"])
    store.ingest(f"file://{top}", archive=f"file://{tmp_path}/scanned", day="2024-01-02")
    assert store.messages().count() == 2 and not (top / "sub" / "a.eml").exists() and (top / "other.txt").exists()
    names = sorted(p.name for p in (tmp_path / "scanned").glob("*.zip"))
    assert names == ["2024-01-02.zip", "2024-01-02_2.zip"]
    with zipfile.ZipFile(tmp_path / "scanned" / names[1]) as z:
        assert z.read("2024-01-02/sub/a.eml") == MAILS["M04"]
    assert files.free_name({"a.zip", "a_2.zip"}.__contains__, "a", ".zip", 2) == "a_3.zip"


def test_migration(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([("a", "1")], "domain string, registrar string").write.parquet(path)
    assert tables.migrate(spark, path, ["domain", "notes", "registrar"]) and not tables.migrate(spark, path, ["domain", "notes", "registrar"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", "", "1")]
    with pytest.raises(ValueError, match="unknown columns: notes"):
        tables.migrate(spark, path, ["domain", "registrar"])


def test_pages_of_wallets():
    from urllib.error import HTTPError

    from siftline.sources import explorers

    tx = lambda i, ok=True: {"txid": f"t{i}", "status": {"confirmed": ok}}
    asked = []

    def get(url):
        asked.append(url.rpartition("addresses/")[2] if "/v2/" in url else url.rpartition("address/")[2])
        if url.endswith("w"):
            return {"chain_stats": {"tx_count": 60}}
        if url.endswith("/txs"):
            return [tx(-1, False)] + [tx(i) for i in range(25)]
        if url.endswith("/chain/t24"):
            return [tx(i) for i in range(24, 49)]
        if url.endswith("/chain/t48"):
            return [tx(49)]
        if url.endswith("/e"):
            return {"coin_balance": "5"}
        if url.endswith("/counters"):
            return {"transactions_count": "3"}
        if url.endswith("/transactions"):
            return {"items": [{"hash": 1}], "next_page_params": {"a": 1, "b": "x y"}}
        if "?" in url:
            return {"items": [{"hash": 2}]}
        raise HTTPError(url, 404 if url.endswith("gone") else 400, "no", None, None)

    got = json.loads(explorers.btc_wallet(get, "w", pause=0))
    assert [t["txid"] for t in got["transactions"]] == ["t-1", *[f"t{i}" for i in range(50)]] and asked == ["w", "w/txs", "w/txs/chain/t24", "w/txs/chain/t48"]
    assert len(json.loads(explorers.btc_wallet(get, "w", most=30, pause=0))["transactions"]) == 30
    asked.clear()
    assert [t["hash"] for t in json.loads(explorers.eth_wallet(get, "e", pause=0))["transactions"]] == [1, 2] and asked[-1] == "e/transactions?a=1&b=x+y"
    assert json.loads(explorers.eth_wallet(get, "gone")) == {"info": {}, "counters": {}, "transactions": []}
    with pytest.raises(HTTPError):
        explorers.eth_wallet(get, "bad")
    assert explorers.ip_client(lambda url, keys: [{"query": k, "n": i} for i, k in enumerate(reversed(keys))])(["a", "b"]) == ['{"query": "a", "n": 1}', '{"query": "b", "n": 0}']


def test_failed_domains(spark):
    a = spark.createDataFrame([("a.b", None, "PywhoisError: No match: for a"), ("c.d", None, "TimeoutError: x")], "domain string, answer string, error string")
    assert [(r.domain, r.notes) for r in E.failed_domains(a).collect()] == [("a.b", "Bad Request -- WHOIS lookup failed: No match: for a")]
