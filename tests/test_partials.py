"""Relations that are kept between runs against the same relations of all messages at once."""

import json

import pytest
from pyspark.sql import functions as F
from test_fixtures import MAILS

from siftline.operators import scratch
from siftline.plans import partials, report
from siftline.plans.store import Store


def documents(store):
    out = {}
    for counted in (False, True):
        text = []
        store.document(text.append, "now", counted=counted)
        out[counted] = json.loads("".join(text))
    return out[False], out[True]


def facts(store, spark):
    store.replace("domain_enrichment", spark.sql("SELECT * FROM VALUES ('x.example', '2024-01-01', 'R', 'ns1.h.net'), ('other.example', '2024-01-05', 'r', 'ns2.h.net') AS t(domain, registered_date, registrar, nameservers)"))
    store.replace("ip_enrichment", spark.sql("SELECT '8.8.8.8' AS ip, 'AS1' AS asn, 'N' AS as_name, 'I' AS isp, 'C' AS country, 'CC' AS country_code"))


def test_document_of_kept_counts_is_that_of_all_messages(spark, tmp_path):
    """Three writers, the last a stream; copies of earlier mail among the later."""
    store = Store(spark, f"file://{tmp_path}/store")
    facts(store, spark)
    names = sorted(MAILS)
    parts = [names[0::3], names[1::3], names[2::3]]
    for i, part in enumerate(parts):
        folder = tmp_path / f"in{i}"
        folder.mkdir()
        for n in part + parts[0][:3]:
            (folder / f"{n}.eml").write_bytes(MAILS[n])
        if i < 2:
            store.ingest(f"file://{folder}")
        else:
            store.stream(f"file://{folder}", f"file://{tmp_path}/checkpoint").awaitTermination()
        if i == 0:
            assert store.count() == 1 and store.count() == 0
    whole, kept = documents(store)
    assert kept == whole and list(kept) == report.KEYS and kept["message_total"] == len(MAILS) - 1
    assert all(kept[k] for k in ("trends", "domains", "registration_clusters", "asns", "ips", "template_clusters", "brands", "phones", "contact_emails", "wallets", "images", "fingerprints"))
    tables = partials.ReportPartials(spark, store.path("partials"))
    assert store.count() == 0 and tables.batches() == 3
    tables.compact()
    assert tables.batches() == 1 and store.count() == 0
    assert documents(store)[1] == whole


def test_no_messages(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    whole, kept = documents(store)
    assert kept == whole and kept["message_total"] == 0 and not kept["domains"]


def relation(spark, rows):
    """Messages of ``(seq, domain, category, phones)``, one with nulls where ``domain`` is null."""
    d = spark.createDataFrame(rows, "seq long, from_domain string, category string, phones array<string>")
    empty = F.array().cast("array<string>")
    found = F.transform("phones", lambda x: F.struct(F.lit("phone").alias("kind"), x.alias("value"), (F.length(x) > 3).alias("functional")))
    d = d.withColumns({"id": F.concat(F.lit("i"), "seq"), "subject": F.when(F.col("seq") % 2 == 0, F.repeat(F.lit("s"), 100)), "from_addr": F.lit("a@x"), "date_iso": F.lit(None).cast("string"), "brands": empty, "indicators": found, "fp": F.col("seq") % 2})
    return d.withColumns({c: empty for c in ("contacts_functional", "phones_functional", "image_hashes", "image_phashes", "image_filenames")} | {"key": F.lit("clash"), "kind": F.lit("clash"), "n": F.lit(7), "item": F.lit("clash")})


ROWS = [(i, [None, "", "a.example", "b.example"][i % 4], ["review", "likely_scam", None][i % 3], [["+1"], ["+1", "+1", "+22 2"], None, []][i % 4]) for i in range(40)]


def test_messy_messages_in_any_order_of_batches(spark):
    """Nulls, repeated values in one message, clashing names, and batches whose places overlap."""
    m = relation(spark, ROWS)
    want = {k: sorted(map(repr, d.collect())) for k, d in (("phones", report.contacts(m, "phone")), ("trends", report.R.trends(m, counted=True)))}
    cuts = [[F.col("seq") < 25, F.col("seq") >= 25], [F.col("seq") % 3 == 2, F.col("seq") > 99, F.col("seq") % 3 != 2]]
    for cut in cuts:
        kept = partials.ReportPartials(spark, scratch.place(spark, "partials"), templates=False)
        for i, which in enumerate(cut):
            assert kept.add(m.where(which), f"b{i}") and not kept.add(m, f"b{i}")
        t = kept.tables()
        assert sorted(map(repr, partials.contacts(t, "phone").collect())) == want["phones"]
        assert sorted(map(repr, partials.trends(t).collect())) == want["trends"]
    assert t["samples"].groupBy("kind", "key").count().agg(F.max("count")).first()[0] <= partials.KEPT
    with pytest.raises(ValueError, match="not a batch name"):
        kept.add(m, "a/b")


def test_a_batch_that_failed_leaves_no_trace(spark, tmp_path):
    m = relation(spark, ROWS)
    kept = partials.ReportPartials(spark, f"file://{tmp_path}/k", templates=False)
    kept.add(m.where("seq < 9"), "a")
    broken = partials.ReportPartials(spark, f"file://{tmp_path}/k", templates=False)
    broken._tables.marks = kept._tables.marks
    broken._tables._fs = None
    with pytest.raises(AttributeError):
        broken.add(m, "b")
    assert kept.names() == {"a"}
    kept.add(m.where("seq >= 9"), "b")
    assert kept.tables()["groups"].agg(F.sum(F.when(F.col("kind") == "month", F.col("n")))).first()[0] == len(ROWS)
