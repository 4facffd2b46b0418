"""Report relations over ``messages``.

Columns read: ``id, seq, from_domain, from_addr, category, scam_score, date, date_iso, subject, from_name, brands`` and
``indicators``, an array of (kind, value, functional).  ``seq`` is the ingest order and breaks all ties.

Lists that are shown in part are cut by ranks before they are gathered, so of a
sender or indicator with a third of all messages each task sends on a few rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import columns as C

CATEGORIES = ("likely_scam", "review", "bulk_marketing")


def domains_of(domain: str = "from_domain") -> Column:
    """Number of distinct sender domains of a group."""
    return F.countDistinct(F.when(F.col(domain) != "", F.col(domain)))


def samples(d: DataFrame, *keys: str, subjects: int = 4, ids: int = 6, width: int = 80) -> DataFrame:
    """``(*keys, sample_subjects, sample_ids)``: of each group's first rows by ``seq``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    first = d.select(*keys, "seq", F.substring("subject", 1, width).alias("subject"), "id").withColumn("_r", rank).where(F.col("_r") <= max(subjects, ids))
    g = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "subject", "id"))).alias("_s"))
    part = lambda f, n: F.transform(F.slice("_s", 1, n), lambda x: x[f])
    return g.select(*keys, part("subject", subjects).alias("sample_subjects"), part("id", ids).alias("sample_ids"))


def smallest(d: DataFrame, keys: list[str], value: str, show: int, name: str) -> DataFrame:
    """``(*keys, n_<name>, <name>)``: how many distinct values each group has, and the ``show`` smallest."""
    one = d.select(*keys, value).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    some = one.withColumn("_r", rank).where(F.col("_r") <= show).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}")).join(some, keys)


def category_counts(m: DataFrame) -> DataFrame:
    given = m.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return given.join(m.groupBy("category").agg(F.count(F.lit(1)).alias("messages")), "category", "left").select("category", F.coalesce("messages", F.lit(0)).alias("messages"))


def repeated_senders(m: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` sender keys by messages, then those of two or more."""
    g = m.where("from_domain <> ''").groupBy(C.sender_key(F.col("from_domain"), F.col("from_addr")).alias("sender")).agg(F.count(F.lit(1)).alias("messages"), F.min("seq").alias("first"))
    return g.orderBy(F.desc("messages"), "first").limit(top).where("messages >= 2").select("sender", "messages")


def triage_queue(m: DataFrame, done: DataFrame) -> DataFrame:
    """Suspect messages whose id is in no triage row."""
    return m.where("category IN ('likely_scam', 'review')").join(done.select("id").distinct(), "id", "left_anti")


def sender_domains(m: DataFrame, by_key: bool) -> DataFrame:
    """Messages and categories by sender domain (two or more), or by sender key (all)."""
    key = C.sender_key(F.col("from_domain"), F.col("from_addr")) if by_key else F.col("from_domain")
    d = m.where("from_domain <> ''").withColumn("sender", key)
    g = d.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
    g = g if by_key else g.where("messages >= 2")
    return g.join(samples(d, "sender"), "sender").select("sender", "messages", "categories", F.array_join("sample_ids", ", ").alias("sample_ids"))


def trends(m: DataFrame, counted: bool = False) -> DataFrame:
    """By month: messages, categories, sender domains first seen, and the three commonest brands, as text or ``counted``.

    The month is ``m.month`` where there is one, else it is cut from ``date_iso``.
    """
    known = F.col("month") if "month" in m.columns else F.substring(F.coalesce("date_iso", F.lit("")), 1, 7)
    d = m.withColumn("month", F.when(known == "", "(unknown)").otherwise(known))
    counts = d.groupBy("month").agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in CATEGORIES])
    fresh = d.where("from_domain <> ''").groupBy("from_domain").agg(F.min("month").alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("new_domains"))
    brand = d.select("month", "seq", F.posexplode("brands").alias("at", "brand")).groupBy("month", "brand").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "at")).alias("at"))
    return trend_rows(counts, fresh, brand, counted)


def trend_rows(counts: DataFrame, fresh: DataFrame, brand: DataFrame, counted: bool) -> DataFrame:
    """Months from their ``counts``, the domains first seen (``fresh``), and ``brand(month, brand, n, at)``."""
    rank = F.row_number().over(W.partitionBy("month").orderBy(F.desc("n"), "at"))
    top = brand.withColumn("r", rank).where("r <= 3").groupBy("month").agg(F.array_sort(F.collect_list(F.struct("r", "brand", F.col("n").alias("count")))).alias("top"))
    out = counts.join(fresh, "month", "left").join(top, "month", "left").select("*", F.coalesce("top", F.array()).alias("t"))
    shown = F.transform("t", lambda x: F.struct(x["brand"].alias("brand"), x["count"].alias("count"))) if counted else F.array_join(F.transform("t", lambda x: x["brand"]), ", ")
    return out.select("month", "total", *CATEGORIES, F.coalesce("new_domains", F.lit(0)).alias("new_domains"), shown.alias("top_brands"))


def brand_counts(m: DataFrame) -> DataFrame:
    return m.select("from_domain", "category", F.explode("brands").alias("brand")).groupBy("brand").agg(F.count(F.lit(1)).alias("messages"), domains_of().alias("domains"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))


def exploded(m: DataFrame) -> DataFrame:
    """One row per indicator of a message; ``at`` is its place in the message."""
    d = m.select("seq", "id", "subject", "from_domain", "category", F.posexplode("indicators").alias("at", "_i"))
    return d.select("seq", "id", "subject", "from_domain", "category", "at", "_i.kind", "_i.value", "_i.functional")


def indicators(m: DataFrame, kind: str) -> DataFrame:
    """Phones, addresses, wallets, images or origin addresses: times seen, sender domains, and whether any is functional."""
    g = exploded(m).where(F.col("kind") == kind).groupBy("value")
    return g.agg(F.count(F.lit(1)).alias("times_seen"), domains_of().alias("domains"), F.when(F.bool_or("functional"), "functional").otherwise("filler").alias("confidence"), F.min("seq").alias("first_seq"))


def artifacts(ips: DataFrame) -> DataFrame:
    """``(value)``: addresses of ``ips(ip, isp, asn)`` that are version stamps of a mail exchange."""
    return ips.where(C.is_artifact(F.col("ip"), F.col("isp"), F.col("asn"))).select(F.col("ip").alias("value")).distinct()


def operator_fingerprints(m: DataFrame, ips: DataFrame | None = None, show: int = 8, safe: bool = True) -> DataFrame:
    """Indicators that two or more sender domains share; wallets and addresses of origin first, then functional ones.

    Addresses of origin that ``ips`` shows to be artifacts take no part.
    """
    return shared_indicators(exploded(m).where("from_domain <> ''"), ips, show, safe)


def shared_indicators(x: DataFrame, ips: DataFrame | None, show: int = 8, safe: bool = True) -> DataFrame:
    """The same from ``(kind, value, from_domain, functional, seq, at)``; one row for each value and domain is enough."""
    if ips is not None:
        x = x.join(artifacts(ips).withColumn("kind", F.lit("ip")), ["kind", "value"], "left_anti")
    domain = C.defang_domain(F.col("from_domain")) if safe else F.col("from_domain")
    d = x.groupBy("kind", "value", domain.alias("domain")).agg(F.bool_or("functional").alias("functional"), F.min(F.struct("seq", "at")).alias("first"))
    g = d.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("domain_count"), F.bool_or("functional").alias("functional"), F.min("first").alias("first")).where("domain_count >= 2")
    few = smallest(d.join(g.select("kind", "value"), ["kind", "value"], "left_semi"), ["kind", "value"], "domain", show, "shown")
    rank = F.when(F.col("kind").isin("btc", "eth", "ip"), 0).when((F.col("kind") == "image") | F.col("functional"), 1).otherwise(2)
    return g.join(few, ["kind", "value"]).select("kind", "value", rank.alias("rank"), "domain_count", F.array_join("shown", "; ").alias("domains"), "functional", "first")


def origin_asns(m: DataFrame, ips: DataFrame) -> DataFrame:
    """By autonomous system, from ``ips(ip, asn, as_name, isp, country_code)``; names are those of the smallest address."""
    d = exploded(m).where("kind = 'ip'").select("seq", "from_domain", "category", F.col("value").alias("ip")).join(ips, "ip").where("asn <> ''")
    code = F.when(F.col("country_code") != "", F.col("country_code"))
    return d.groupBy("asn").agg(
        F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("category") == "likely_scam", 1)).alias("likely_scam"), F.countDistinct("ip").alias("ips"), domains_of().alias("domains"),
        F.min_by("as_name", "ip").alias("as_name"), F.min_by("isp", "ip").alias("isp"), F.array_sort(F.collect_set(code)).alias("countries"), F.min("seq").alias("first_seq"),
    )


def unenriched_ips(m: DataFrame, ips: DataFrame, blank_counts: bool) -> DataFrame:
    """Distinct origin addresses with no row, or with no or a blank number."""
    d = exploded(m).where("kind = 'ip'").select(F.col("value").alias("ip")).distinct().join(ips, "ip", "left")
    return d.agg(F.count(F.when(F.col("asn").isNull() | (F.lit(blank_counts) & (F.col("asn") == "")), 1)).alias("unenriched"))


def registration_clusters(domains: DataFrame, messages_by_domain: DataFrame) -> DataFrame:
    """Domains with one registrar and one set of name-server roots, two or more; ``domains(domain, registered_date, registrar, nameservers)``.

    ``span_days`` lies between the first and the last of two or more dates in the
    order of their texts; null if either is no date.
    """
    d = domains.select("domain", F.lower(F.trim("registrar")).alias("registrar"), C.ns_roots(F.col("nameservers")).alias("roots"), F.trim("registered_date").alias("registered")).where("registrar <> '' AND size(roots) > 0")
    d = d.join(messages_by_domain, "domain", "left")
    dates = F.array_sort(F.collect_list(F.when(F.col("registered") != "", F.col("registered"))))
    g = d.groupBy("registrar", F.array_join("roots", "; ").alias("nameserver_roots")).agg(F.count(F.lit(1)).alias("domain_count"), F.array_join(F.array_sort(F.collect_list("domain")), "; ").alias("domains"), dates.alias("dates"), F.sum(F.coalesce("messages", F.lit(0))).alias("messages"))

    def day(at: int) -> Column:
        text = F.substring(F.try_element_at("dates", F.lit(at)), 1, 10)
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")

    span = F.when(F.size("dates") > 1, F.datediff(day(-1), day(1))).cast("long")
    return g.where("domain_count >= 2").select("registrar", "nameserver_roots", "domain_count", "domains", span.alias("span_days"), "messages", "dates")


def actions(log: DataFrame) -> DataFrame:
    """The action log with targets made safe; a blank type is ``other``."""
    given = F.trim(F.coalesce("target_type", F.lit("")))
    kind = F.when(given == "", "other").otherwise(given)
    return log.select("date", "action", kind.alias("target_type"), C.defang_target(kind, F.trim(F.coalesce("target", F.lit("")))).alias("target"), "reference", "status", "notes", *[c for c in ("seq",) if c in log.columns])
