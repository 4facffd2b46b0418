"""Relations of the report that are kept between runs: a batch of messages adds its partial counts, and the report merges those.

Three tables, a folder of each per batch (:mod:`siftline.operators.batches`):

* ``groups(kind, key, category, n, functional, seq, at, of)``: how often a key was seen in messages of a category, whether it
  is functional, its first place, and the sender domain there;
* ``pairs(kind, key, item, n, functional, seq, at)``: which items, such as sender domains, a key was seen with;
* ``samples(kind, key, seq, at, subject, id)``: the first six sightings of a key.

Keys are senders, sender domains, brands, months, template fingerprints and the
kinds of indicators.  Counts add up, places and flags take the least or any, and
samples are cut again, so merging is the same in any order of batches and of any
merged part of them.  What is distinct is kept as pairs, never as a list, so no
row grows with the messages, and of a key with a third of all messages each task
sends on a few rows.  Template clusters come from the fingerprints' groups and
the labels of a :class:`siftline.operators.template_index.TemplateIndex`.

Defined results: those of ``plans.report`` over all messages that were added.  A
batch whose name was added before changes nothing; an empty one adds no rows; no
batches give empty relations.  Messages need a ``seq`` of their own over all
batches.  Other columns of the messages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators.batches import BatchTables
from siftline.operators.scratch import drop, saved
from siftline.operators.template_index import TemplateIndex
from siftline.plans import enrichment as E
from siftline.plans import relations as R
from siftline.plans import report

KINDS = {
    "groups": "kind string, key string, category string, n long, functional boolean, seq long, at int, of string",
    "pairs": "kind string, key string, item string, n long, functional boolean, seq long, at int",
    "samples": "kind string, key string, seq long, at int, subject string, id string",
}
INDICATORS = ("phone", "email", "btc", "eth", "image", "ip")
SAMPLED = ("sender", "brand", "template", *INDICATORS)
#: Samples that a key keeps, as many as any relation shows, and the characters of their subjects.
KEPT, WIDTH = 6, 80


def _keys() -> Column:
    """The keys under which a message counts, as (kind, key, at, functional)."""
    c = F.col
    no = F.lit(False)

    def key(kind: Column | str, value: Column, at: Column = F.lit(0), functional: Column = no) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), value.cast("string").alias("key"), at.cast("int").alias("at"), F.coalesce(functional, no).alias("functional"))

    domain = F.coalesce("from_domain", F.lit(""))
    sender = F.when(domain != "", F.array(key("sender", C.sender_key(c("from_domain"), c("from_addr"))), key("domain", domain)))
    template = F.when(c("fp") != 0, F.array(key("template", c("fp"))))
    brands = F.transform("brands", lambda x, i: key("brand", x, i))
    found = F.transform("indicators", lambda x, i: key(x["kind"], x["value"], i, x["functional"]))
    parts = [sender, template, F.array(key("month", c("_month"))), brands, found]
    empty = F.array().cast("array<struct<kind:string,key:string,at:int,functional:boolean>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _pairs() -> Column:
    """What is seen together in a message, as (kind, key, item, at, functional)."""
    c = F.col
    no, domain = F.lit(False), F.coalesce("from_domain", F.lit(""))

    def pair(kind: Column | str, key: Column, item: Column, at: Column = F.lit(0), functional: Column = no) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), key.cast("string").alias("key"), item.alias("item"), at.cast("int").alias("at"), F.coalesce(functional, no).alias("functional"))

    by_domain = [
        F.transform("indicators", lambda x, i: pair(x["kind"], x["value"], domain, i, x["functional"])), F.transform("brands", lambda x, i: pair("brand", x, domain, i)),
        F.when(c("fp") != 0, F.array(pair("template", c("fp"), domain))), F.array(pair("first month", domain, c("_month"))),
    ]
    others = [
        F.transform("brands", lambda x, i: pair("month", c("_month"), x, i)),
        F.when(c("fp") != 0, F.transform("contacts_functional", lambda x, i: pair("template email", c("fp"), x, i))),
        F.when(c("fp") != 0, F.transform("phones_functional", lambda x, i: pair("template phone", c("fp"), x, i))),
        F.transform("image_hashes", lambda x, i: pair("likeness", x, F.get("image_phashes", i), i)), F.transform("image_hashes", lambda x, i: pair("file", x, F.get("image_filenames", i), i)),
    ]
    parts = [F.when(domain != "", p) for p in by_domain] + others
    empty = F.array().cast("array<struct<kind:string,key:string,item:string,at:int,functional:boolean>>")
    return F.filter(F.concat(*[F.coalesce(p, empty) for p in parts]), lambda x: x["item"].isNotNull())


def partials(m: DataFrame) -> dict[str, DataFrame]:
    """The three tables of some messages; ``m`` is the relation of ``plans.messages``."""
    month = F.col("month") if "month" in m.columns else F.substring(F.coalesce("date_iso", F.lit("")), 1, 7)
    m = m.withColumn("_month", F.when(month == "", "(unknown)").otherwise(month))
    x = m.select("seq", "id", F.substring("subject", 1, WIDTH).alias("subject"), F.col("from_domain").alias("of"), "category", F.inline(_keys())).withColumn("n", F.lit(1).cast("long"))
    p = m.select("seq", F.inline(_pairs())).withColumn("n", F.lit(1).cast("long"))
    return {"groups": merged("groups", x), "pairs": merged("pairs", p), "samples": merged("samples", x.where(F.col("kind").isin(*SAMPLED)))}


def merged(table: str, rows: DataFrame) -> DataFrame:
    """One row per key, of rows of one or of many batches."""
    names = [c.split()[0] for c in KINDS[table].split(", ")]
    if table == "samples":
        rank = F.row_number().over(W.partitionBy("kind", "key").orderBy("seq", "at"))
        return rows.withColumn("_r", rank).where(F.col("_r") <= KEPT).select(*names)
    place = F.struct("seq", "at")
    found = [F.sum("n").alias("n"), F.bool_or("functional").alias("functional"), F.min(place).alias("_p")]
    if table == "groups":
        found.append(F.min_by("of", place).alias("of"))
    g = rows.groupBy(*names[:3]).agg(*found)
    return g.withColumns({"seq": F.col("_p.seq"), "at": F.col("_p.at")}).select(*names)


class ReportPartials:
    """The tables in ``folder``, and the index of templates beside them, unless ``templates`` is false: then no message is in a cluster."""

    def __init__(self, spark: SparkSession, folder: str, templates: bool = True):
        self.templates = TemplateIndex(spark, f"{folder.rstrip('/')}/templates") if templates else None
        self._tables = BatchTables(spark, folder, KINDS)

    def add(self, m: DataFrame, name: str) -> bool:
        """Add the messages of the batch ``name`` (letters and digits); false if it is there already."""
        at = self._tables.next(name)
        if at is None:
            return False
        copy = saved(m, "messages")
        if self.templates:
            self.templates.add(copy.select("seq", "fp"), "seq", name)  # skipped if a run broke off after this line
        self._tables.write(partials(copy), at, name)
        drop(copy)
        return True

    def names(self) -> set[str]:
        """Batches that were added, under their names."""
        return {m[2] for m in self._tables.marks() if m[2]}

    def batches(self) -> int:
        """How many batches have folders of their own."""
        marks = self._tables.marks()
        whole = max((n for n, every, _ in marks if every), default=0)
        return sum(n >= whole for n, *_ in marks)

    def compact(self) -> None:
        """Merge all batches into one; worth it when many small ones slow the report."""
        if self._tables.marks():
            self._tables.fold({t: merged(t, self._tables.read(t)) for t in KINDS})
        if self.templates:
            self.templates.compact()

    def tables(self) -> dict[str, DataFrame]:
        """The merged tables, and ``labels(fp, label)``."""
        return {t: merged(t, self._tables.read(t)) for t in KINDS} | ({"labels": self.templates.labels()} if self.templates else {})


def _of(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def _counted(t: dict[str, DataFrame], kinds: tuple[str, ...], key: str, *more: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``(key, n, categories, distinct_domains, first, first_seq, functional)`` of the keys of some kinds."""
    place = F.struct("seq", "at")
    found = [F.sum("n").alias("n"), F.array_sort(F.collect_set("category")).alias("categories"), F.bool_or("functional").alias("functional"), F.min(place).alias("first"), F.min("seq").alias("first_seq")]  # a handful of categories
    g = _of(t["groups"], *kinds).groupBy(*by, F.col("key").alias(key)).agg(*found, *more)
    domains = _of(t["pairs"], *kinds).groupBy(*by, F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("_domains"))
    return g.join(domains, [*by, key], "left").withColumn("distinct_domains", F.coalesce("_domains", F.lit(0).cast("long"))).drop("_domains")


def _samples(t: dict[str, DataFrame], kinds: tuple[str, ...], key: str) -> DataFrame:
    return R.samples(_of(t["samples"], *kinds).withColumnRenamed("key", key), key)


def trends(t: dict[str, DataFrame]) -> DataFrame:
    g = _of(t["groups"], "month").groupBy(F.col("key").alias("month"))
    counts = g.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in R.CATEGORIES])
    fresh = _of(t["pairs"], "first month").groupBy("key").agg(F.min("item").alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("new_domains"))
    brand = _of(t["pairs"], "month").select(F.col("key").alias("month"), F.col("item").alias("brand"), "n", F.struct("seq", "at").alias("at"))
    return R.trend_rows(counts, fresh, brand, counted=True)


def domains(t: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    g = _counted(t, ("sender",), "sender", F.min_by("of", F.struct("seq", "at")).alias("of")).withColumnRenamed("n", "count")
    return report.domain_rows(g.join(_samples(t, ("sender",), "sender"), "sender"), facts)


def registrations(t: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    return report.registration_rows(facts, _of(t["groups"], "domain").groupBy(F.col("key").alias("domain")).agg(F.sum("n").alias("messages")))


def asns(t: dict[str, DataFrame], ips: DataFrame) -> DataFrame:
    known = ips.where("asn <> ''")
    number = known.select(F.col("ip").alias("key"), "asn")
    g = _of(t["groups"], "ip").join(known.withColumnRenamed("ip", "key"), "key").groupBy("asn").agg(
        F.sum("n").alias("messages"), F.coalesce(F.sum(F.when(F.col("category") == "likely_scam", F.col("n"))), F.lit(0)).alias("likely_scam"), F.countDistinct("key").alias("distinct_ips"),
        F.min_by("as_name", "key").alias("as_name"), F.min_by("isp", "key").alias("isp"), F.array_sort(F.collect_set(F.when(F.col("country_code") != "", F.col("country_code")))).alias("countries"), F.min("seq").alias("first_seq"),
    )
    by = _of(t["pairs"], "ip").join(number, "key").groupBy("asn").agg(F.countDistinct("item").alias("_domains"))
    g = g.join(by, "asn", "left").withColumn("distinct_domains", F.coalesce("_domains", F.lit(0).cast("long")))
    return report.asn_rows(g.join(R.samples(_of(t["samples"], "ip").join(number, "key"), "asn"), "asn"))


def ips(t: dict[str, DataFrame], facts: DataFrame, safe: bool = True) -> DataFrame:
    seen = _counted(t, ("ip",), "ip").withColumnRenamed("n", "times_seen")
    return report.ip_rows(E.ip_facts(seen, facts).join(_samples(t, ("ip",), "ip"), "ip"), safe)


def template_clusters(t: dict[str, DataFrame], safe: bool = True) -> DataFrame:
    """Fingerprints by the label of their cluster; clusters of one message are none."""
    label = t["labels"].select(F.col("fp").cast("string").alias("key"), F.col("label").alias("_c"))
    labelled = lambda table, *kinds: _of(t[table], *kinds).join(label, "key")
    g = labelled("groups", "template").groupBy("_c").agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("category")).alias("categories"), F.min("seq").alias("first_seq")).where("count > 1")
    by = labelled("pairs", "template").groupBy("_c").agg(F.countDistinct("item").alias("_domains"))
    shown = F.when(F.col("kind") == "template email", C.defang_email(F.col("item"))).otherwise(F.col("item")) if safe else F.col("item")
    contacts = labelled("pairs", "template email", "template phone").groupBy("_c").agg(F.array_sort(F.collect_set(shown)).alias("contacts"))
    g = g.join(by, "_c", "left").withColumn("distinct_domains", F.coalesce("_domains", F.lit(0).cast("long")))
    return report.cluster_rows(g.join(contacts, "_c", "left").join(R.samples(labelled("samples", "template"), "_c"), "_c"))


def brands(t: dict[str, DataFrame]) -> DataFrame:
    g = _counted(t, ("brand",), "brand").withColumnRenamed("n", "count")
    return g.join(_samples(t, ("brand",), "brand"), "brand").select("brand", "count", "categories", "distinct_domains", "sample_subjects", "sample_ids", "first")


def contacts(t: dict[str, DataFrame], kind: str, safe: bool = True) -> DataFrame:
    g = _counted(t, (kind,), "value").withColumnRenamed("n", "times_seen")
    return report.contact_rows(g.join(_samples(t, (kind,), "value"), "value"), kind, safe)


def wallets(t: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    seen = _counted(t, ("btc", "eth"), "address", by=("kind",)).withColumnRenamed("n", "times_seen").withColumn("chain", F.upper("kind"))
    return report.wallet_rows(E.wallet_facts(seen, facts.drop("chain")).join(_samples(t, ("btc", "eth"), "address"), "address"))


def images(t: dict[str, DataFrame]) -> DataFrame:
    g = _counted(t, ("image",), "hash").withColumnRenamed("n", "times_seen")
    likeness = _of(t["pairs"], "likeness").groupBy(F.col("key").alias("hash")).agg(F.min_by("item", F.struct("seq", "at")).alias("_likeness"))
    names = R.smallest(_of(t["pairs"], "file").withColumnRenamed("key", "hash"), ["hash"], "item", 4, "filenames").select("hash", "filenames")
    g = g.join(likeness, "hash", "left").withColumn("phash", F.coalesce("_likeness", F.lit("")))
    return report.image_rows(g.join(names, "hash", "left").join(_samples(t, ("image",), "hash"), "hash"))


def fingerprints(t: dict[str, DataFrame], facts: DataFrame | None, safe: bool = True) -> DataFrame:
    x = _of(t["pairs"], *INDICATORS).withColumnsRenamed({"key": "value", "item": "from_domain"})
    return report.fingerprint_rows(R.shared_indicators(x, facts, safe=safe), safe)


def relations(t: dict[str, DataFrame], dims: dict[str, DataFrame], safe: bool = True) -> dict[str, DataFrame]:
    """The grouped relations of the document, by its keys, from merged tables; the others are rows of messages or dimensions."""
    facts = dims["ip_enrichment"]
    return {
        "trends": trends(t), "domains": domains(t, dims["domain_enrichment"]), "registration_clusters": registrations(t, dims["domain_enrichment"]), "asns": asns(t, facts), "ips": ips(t, facts, safe),
        "template_clusters": template_clusters(t, safe), "brands": brands(t), "phones": contacts(t, "phone", safe), "contact_emails": contacts(t, "email", safe),
        "wallets": wallets(t, dims["wallet_enrichment"]), "images": images(t), "fingerprints": fingerprints(t, facts, safe),
    }


def counts(t: dict[str, DataFrame], ips: DataFrame) -> dict[str, object]:
    """The document's plain numbers."""
    by = {r.category: r.n for r in _of(t["groups"], "month").groupBy("category").agg(F.sum("n").alias("n")).orderBy("category").collect()}  # a handful of categories
    d = _of(t["groups"], "ip").select(F.col("key").alias("ip")).distinct().join(ips, "ip", "left")
    return {"message_total": sum(by.values()), "category_counts": by, "unenriched_ip_count": d.where("asn IS NULL").count()}
