"""Mail files, the message parser, context rules and the streaming ingest."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.plans.store import Store
from siftline.sources import mail, tables
from siftline.streaming.ingest import ingest

SCAM = b"""Message-ID: <a@x>
From: "PayPal" <support@evil.example>
Reply-To: me@gmail.com
Subject: =?utf-8?q?Ol=C3=A1?=
Date: Mon, 01 Jan 2024 23:30:00 -0500
Authentication-Results: mx; dkim=fail; spf=softfail; dmarc=fail
Received: from [10.0.0.1] by (8.8.8.8) id 15.21.245.11
Content-Type: text/html; charset=utf-8

<p>Please contact help@shop.example now</p><a href="http://evil.top/x">www.paypal.com</a><div style="display:none">no<div>no</div>leak</div><img src="http://pix.example/1.gif"><a href="/here">here</a>
"""
PLAIN = b"From: bob@friend.example\nSubject: hi\nDate: never\n\nbody\n"


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "old").mkdir(parents=True)
    (root / "a.EML").write_bytes(SCAM)
    (root / "old" / "b.mbox").write_bytes(b"From x\n" + SCAM + b"\nFrom y\n" + PLAIN)
    (root / "notes.txt").write_bytes(PLAIN)
    return tmp_path


def test_read(spark, folder):
    got = mail.signals(mail.read_mail(spark, str(folder / "in"))).orderBy("path", "position").collect()
    assert [(r.source, r.position) for r in got] == [("input", 0), ("old", 0), ("old", 1)]
    r = got[0]
    assert (r.subject, r.from_name, r.from_domain, r.reply_domain, r.date_iso) == ("Olá", "PayPal", "evil.example", "gmail.com", "2024-01-02")
    assert (r.dkim, r.spf, r.dmarc, r.originating_ips) == ("fail", "softfail", "fail", ["8.8.8.8"])
    assert r.link_mismatches == ["www.paypal.com => evil.top"] and r.urls == ["http://evil.top/x", "/here"] and r.remote_image_domains == ["pix.example"]
    assert r.contacts_functional == ["help@shop.example"] and r.contacts_filler == []
    assert "leak" in r.body and "no" not in r.body.replace("now", "").split()
    assert (r.category, r.scam_score) == ("likely_scam", 3 + 2 + 2 + 1 + 1 + 2)
    assert (got[2].category, got[2].date_iso) == ("review", "")
    assert mail.new_messages(mail.signals(mail.read_mail(spark, str(folder / "in")))).count() == 2


def test_ages(spark, folder):
    ages = spark.createDataFrame([("friend.example", 5)], "domain string, age int")
    got = mail.signals(mail.read_mail(spark, str(folder / "in")), ages=ages).where("from_domain = 'friend.example'").collect()
    assert [r.scam_score for r in got] == [3]


def test_empty_and_broken(spark, folder):
    (folder / "in" / "empty.eml").write_bytes(b"")
    (folder / "in" / "odd.eml").write_bytes(b"Subject: \xff\xfe\nContent-Type: text/plain; charset=nonsense\n\n\xff")
    got = mail.signals(mail.read_mail(spark, str(folder / "in"))).where(F.col("path").rlike("(empty|odd).eml$")).collect()
    assert [(r.path.rpartition("/")[2], r.scam_score, len(r.id)) for r in got] == [("odd.eml", 0, 10)]  # Spark lists no empty files


def test_stream(spark, folder):
    def run():
        ingest(spark, str(folder / "in"), str(folder / "t"), str(folder / "c")).awaitTermination(120)
        return spark.read.option("basePath", str(folder / "t")).parquet(str(folder / "t")).select("id").collect()

    assert len(run()) == 2
    (folder / "in" / "c.eml").write_bytes(SCAM)
    (folder / "in" / "d.eml").write_bytes(PLAIN.replace(b"hi", b"ho"))
    ids = run()
    assert len(ids) == len(set(ids)) == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [("+ 1 (656) 556 - 2194", ["1 (656) 556 - 2194"]), ("+1 (656) 556-2194", ["+1 (656) 556-2194"]), ("order 123456789012", []), ("call 123456789012", ["123456789012"]), ("", [])],
)
def test_phones(text, want):
    assert parsing.phones(text) == want


def test_context():
    assert parsing.functional("contact " + "a@b.co c@d.co e@f.co g@h.co", ["a@b.co"], "email") == []
    assert parsing.functional("contact a@b.co", ["a@b.co"], "email") == ["a@b.co"]
    assert parsing.functional("support@b.co", ["support@b.co"], "email") == []
    assert parsing.functional("call +1 656 555 1234", ["+1 656 555 1234"], "phone") == ["+1 656 555 1234"]
    assert parsing.functional("call +1  656 555 1234", ["+1 656 555 1234"], "phone") == []


def test_plain():
    assert parsing.plain("pay​pаl name (at) site (dot) com") == "paypal name@site.com"


def test_writers_keep_each_others_mail(spark, folder):
    """A run, a stream, a run, the stream again, the stream without its checkpoint: every id once, each with its links, ``seq`` never twice."""
    store = Store(spark, f"file://{folder}/store")
    root, inbox = f"file://{folder}/in", folder / "in"

    def mail_of(n, link="http://l.example/"):
        return PLAIN.replace(b"hi", b"subject %d" % n).replace(b"body", b"see " + link.encode() + b"%d" % n)

    def stream(checkpoint="c"):
        store.stream(root, f"file://{folder}/{checkpoint}", files_at_once=2).awaitTermination(180)

    def state():
        rows = store.typed().select("id", "seq").collect()
        assert len({r.id for r in rows}) == len({r.seq for r in rows}) == len(rows)
        links = store.urls().groupBy("id").count().collect()
        return len(rows), sum(r["count"] for r in links)

    store.ingest(root)
    assert state() == (2, 2)
    for n in range(5):
        (inbox / f"s{n}.eml").write_bytes(mail_of(n % 4))  # the last is a copy of the first, in another batch
    stream()
    assert state() == (6, 6)
    (inbox / "t.eml").write_bytes(mail_of(10))
    store.ingest(root)
    assert state() == (7, 7)
    (inbox / "u.mbox").write_bytes(b"From a\n" + mail_of(10) + b"\nFrom b\n" + mail_of(11) + b"\nFrom c\n" + mail_of(2))
    stream()  # knows what the run between has written
    assert state() == (8, 8)
    stream("another")
    assert state() == (8, 8)
    (inbox / "v.eml").write_bytes(mail_of(12))
    stream("another")
    stream()
    assert state() == (9, 9)


def test_links_of_a_broken_run_do_not_count(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    store.ingest(f"file://{folder}/in")
    before = store.urls().count()
    spark.read.parquet(f"file://{folder}/store/urls/run=0/batch=0").write.parquet(f"file://{folder}/store/urls/run=7/batch=0")
    assert store.urls().count() == before == 2


def test_stream_and_run_give_equal_scores(spark, folder):
    """Ages are read anew for each batch."""
    runs, streams = Store(spark, f"file://{folder}/runs"), Store(spark, f"file://{folder}/streams")
    young = spark.sql("SELECT 'friend.example' AS domain, cast(date_sub(current_date(), 5) AS string) AS registered_date, 'R' AS registrar")
    for store in (runs, streams):
        store.replace("domain_enrichment", young)
    runs.ingest(f"file://{folder}/in")
    streams.stream(f"file://{folder}/in", f"file://{folder}/c").awaitTermination(180)
    rows = lambda s: sorted(map(str, s.typed().drop("seq").collect()))
    assert rows(runs) == rows(streams) and [r.scam_score for r in streams.typed().where("from_domain = 'friend.example'").collect()] == [3]
    streams.replace("domain_enrichment", young.withColumn("domain", F.lit("late.example")))
    (folder / "in" / "late.eml").write_bytes(PLAIN.replace(b"friend.example", b"late.example"))
    streams.stream(f"file://{folder}/in", f"file://{folder}/c").awaitTermination(180)
    assert [r.scam_signals for r in streams.typed().where("from_domain = 'late.example'").collect()] == [["sender domain registered 5 days ago"]]


def test_a_failed_swap_keeps_the_old_table(spark, folder, monkeypatch):
    path = f"file://{folder}/t"
    tables.replace(spark.range(3), path)
    tables.replace(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in folder.iterdir() if p.name.startswith("t")) == ["t"]
    real = tables._file_system(spark, path)

    class Broken:
        def __getattr__(self, name):
            return getattr(real[0], name)

        def rename(self, a, b):
            return False if ".new-" in a.toString() else real[0].rename(a, b)

    monkeypatch.setattr(tables, "_file_system", lambda *_: (Broken(), real[1]))
    with pytest.raises(OSError):
        tables.replace(spark.range(9), path)
    assert spark.read.parquet(path).count() == 2
