"""The whole report: every relation under its key of the JSON document, headline numbers, the sheets, and the ordered run of the steps.

``m`` is the message relation of ``plans.messages``; ``dims`` maps the table
names of ``sources.tables.SCHEMAS`` to DataFrames.  Values are made safe to
show.  A column that is missing is an error, never an empty relation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators import templates
from siftline.operators.graph import numbered
from siftline.plans import enrichment as E
from siftline.plans import messages as M
from siftline.plans import relations as R
from siftline.sources import tables

#: Keys of the document, in order (fixed values).
KEYS = [
    "generated_at", "message_total", "category_counts", "triage_queue", "unenriched_ip_count", "trends", "domains", "registration_clusters", "asns", "ips",
    "template_clusters", "brands", "phones", "contact_emails", "wallets", "wallet_transactions", "images", "fingerprints", "emails", "urls", "actions",
]


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit("")).alias(c)


def _shown(safe: bool, defang: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Values made safe, or as they stand."""
    return defang if safe else lambda x: x


def _safe_list(values: Column) -> Column:
    return F.transform(values, C.defang_domain)


def triage_queue(m: DataFrame, done: DataFrame, safe: bool = True) -> DataFrame:
    """Suspect messages not marked yet; the date is the raw one where the day is unknown."""
    c = F.col
    date = F.when(F.coalesce("date_iso", F.lit("")) != "", c("date_iso")).otherwise(c("date"))
    return R.triage_queue(m, done).select(
        "id", "seq", "category", "scam_score", date.alias("date"), _text("date_iso"), "subject", "from_name",
        _shown(safe, C.defang_email)(c("from_addr")).alias("from_addr"), _shown(safe, C.defang_domain)(c("from_domain")).alias("from_domain"), "scam_signals",
    )


def emails(m: DataFrame) -> DataFrame:
    """Messages for display, their addresses and indicators made safe."""
    c = F.col
    date = F.when(F.coalesce("date_iso", F.lit("")) != "", c("date_iso")).otherwise(c("date"))
    return m.select(
        "id", "seq", "source", "category", "scam_score", "scam_signals", date.alias("date"), "subject", "from_name", C.defang_email(c("from_addr")).alias("from_addr"), C.defang_domain(c("from_domain")).alias("from_domain"),
        C.defang_email(c("reply_to_addr")).alias("reply_to_addr"), "dkim", "spf", "dmarc", C.defang_ip(c("origin_ip")).alias("origin_ip"), "url_count", _safe_list(c("url_domains")).alias("url_domains"),
        C.defang_url(c("first_url")).alias("first_url"), "impersonated_brands", "phone_numbers", F.concat("btc_addresses", "eth_addresses").alias("wallets"),
        F.transform("contact_emails_in_body", C.defang_email).alias("contact_emails"), _safe_list(c("link_mismatches")).alias("link_mismatches"), "url_flags", "image_count",
    )


def urls(links: DataFrame) -> DataFrame:
    """The links of messages made safe, from the table ``urls(id, url, domain)``; other columns stay."""
    return links.withColumns({"url": C.defang_url(F.col("url")), "domain": C.defang_domain(F.col("domain"))})


def domains(m: DataFrame, facts: DataFrame) -> DataFrame:
    """Senders, by domain or, for free mail, by address, with the facts of the domain of their first message."""
    d = m.where("from_domain <> ''").withColumn("sender", C.sender_key(F.col("from_domain"), F.col("from_addr")))
    g = d.groupBy("sender").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("category")).alias("categories"), F.min_by("from_domain", "seq").alias("of"), F.min("seq").alias("first_seq"))
    return domain_rows(g.join(R.samples(d, "sender"), "sender"), facts)


def domain_rows(g: DataFrame, facts: DataFrame) -> DataFrame:
    """Senders ``(sender, count, categories, of, first_seq)`` with their samples, for display with the facts of ``of``."""
    names = [c for c in ("registered_date", "registrar", "nameservers", "registrant_org", "registrant_country", "notes") if c in facts.columns]
    known = facts.select(F.col("domain").alias("of"), *names, F.lit(True).alias("enriched"))
    d = g.join(known, "of", "left")
    is_address = F.col("sender").contains("@")
    return d.select(
        F.when(is_address, C.defang_email(F.col("sender"))).otherwise(C.defang_domain(F.col("sender"))).alias("domain"), is_address.alias("is_freemail_address"),
        F.when(is_address, C.defang_domain(F.col("of"))).otherwise("").alias("provider"), "count", "categories",
        *[F.coalesce(F.col(c) if c in names else F.lit(""), F.lit("")).alias({"registered_date": "registered"}.get(c, c)) for c in ("registered_date", "registrar")],
        _safe_list(C.split_list(F.coalesce(F.col("nameservers") if "nameservers" in names else F.lit(""), F.lit("")))).alias("nameservers"),
        *[F.coalesce(F.col(c) if c in names else F.lit(""), F.lit("")).alias(c) for c in ("registrant_org", "registrant_country", "notes")],
        F.coalesce("enriched", F.lit(False)).alias("enriched"), "sample_subjects", "sample_ids", "first_seq",
    )


def registrations(facts: DataFrame, m: DataFrame) -> DataFrame:
    by = m.where("from_domain <> ''").groupBy(F.col("from_domain").alias("domain")).agg(F.count(F.lit(1)).alias("messages"))
    return registration_rows(facts, by)


def registration_rows(facts: DataFrame, by: DataFrame) -> DataFrame:
    """Registration clusters for display, from ``by(domain, messages)``."""
    safe = lambda c: F.transform(F.split(c, "; "), C.defang_domain)
    return R.registration_clusters(facts, by).select("registrar", F.array_sort(safe("nameserver_roots")).alias("nameserver_roots"), safe("domains").alias("domains"), F.col("dates").alias("registration_dates"), "span_days", "messages", "domain_count")


def asns(m: DataFrame, ips: DataFrame) -> DataFrame:
    seen = R.exploded(m).where("kind = 'ip'").join(ips.where("asn <> ''").select(F.col("ip").alias("value"), "asn"), "value")
    g = R.origin_asns(m, ips).withColumnsRenamed({"ips": "distinct_ips", "domains": "distinct_domains"}).join(R.samples(seen, "asn"), "asn")
    return asn_rows(g)


def asn_rows(g: DataFrame) -> DataFrame:
    """Networks for display, from what was counted of them."""
    return g.select("asn", _text("as_name"), _text("isp"), "countries", "messages", "likely_scam", "distinct_ips", "distinct_domains", "sample_subjects", "sample_ids", "first_seq")


def _with_samples(m: DataFrame, kinds: tuple[str, ...], g: DataFrame, key: str) -> DataFrame:
    seen = R.exploded(m).where(F.col("kind").isin(*kinds)).withColumnRenamed("value", key)
    return g.join(R.samples(seen, key), key)


def ips(m: DataFrame, facts: DataFrame, safe: bool = True) -> DataFrame:
    return ip_rows(_with_samples(m, ("ip",), E.ip_report(m, facts), "ip"), safe)


def ip_rows(d: DataFrame, safe: bool) -> DataFrame:
    """Addresses of origin for display."""
    return d.withColumn("ip", _shown(safe, C.defang_ip)(F.col("ip")))


def template_clusters(m: DataFrame, safe: bool = True) -> DataFrame:
    """Groups of messages with one template, largest first and numbered from 1."""
    d = m.join(templates.clusters(m.select("seq", "fp"), "seq").select("seq", F.col("label").alias("_c")), "seq")
    contact = F.concat(F.transform("contacts_functional", _shown(safe, C.defang_email)), F.col("phones_functional"))
    contacts = d.select("_c", F.explode(contact).alias("x")).groupBy("_c").agg(F.array_sort(F.collect_set("x")).alias("contacts"))
    g = d.groupBy("_c").agg(F.count(F.lit(1)).alias("count"), R.domains_of().alias("distinct_domains"), F.array_sort(F.collect_set("category")).alias("categories"), F.min("seq").alias("first_seq"))
    return cluster_rows(g.join(contacts, "_c", "left").join(R.samples(d, "_c"), "_c"))


def cluster_rows(g: DataFrame) -> DataFrame:
    """Clusters ``(_c, count, distinct_domains, categories, first_seq, contacts)`` with their samples, numbered from 1."""
    g = numbered(g, [F.desc("count"), F.col("first_seq")], "cluster", start=1)
    return g.select("cluster", "count", "distinct_domains", "categories", F.coalesce("contacts", F.array().cast("array<string>")).alias("contacts"), "sample_subjects", "sample_ids")


def brands(m: DataFrame) -> DataFrame:
    d = m.select("seq", "id", "subject", "from_domain", "category", F.posexplode("brands").alias("at", "brand"))
    g = d.groupBy("brand").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("category")).alias("categories"), R.domains_of().alias("distinct_domains"), F.min(F.struct("seq", "at")).alias("first"))
    return g.join(R.samples(d, "brand"), "brand").select("brand", "count", "categories", "distinct_domains", "sample_subjects", "sample_ids", "first")


def contacts(m: DataFrame, kind: str, safe: bool = True) -> DataFrame:
    """Phones or contact addresses; functional ones first."""
    d = R.exploded(m).where(F.col("kind") == kind)
    g = d.groupBy("value").agg(F.bool_or("functional").alias("functional"), F.count(F.lit(1)).alias("times_seen"), R.domains_of().alias("distinct_domains"), F.min(F.struct("seq", "at")).alias("first"))
    return contact_rows(g.join(R.samples(d, "value"), "value"), kind, safe)


def contact_rows(g: DataFrame, kind: str, safe: bool) -> DataFrame:
    """Phones or contact addresses for display, from what was counted of each value."""
    g = g.withColumn("confidence", F.when(F.col("functional"), "functional").otherwise("filler"))
    shown = _shown(safe and kind == "email", C.defang_email)(F.col("value"))
    return g.select(shown.alias("value"), "confidence", "times_seen", "distinct_domains", "sample_subjects", "sample_ids", "first")


def wallets(m: DataFrame, facts: DataFrame) -> DataFrame:
    return wallet_rows(_with_samples(m, ("btc", "eth"), E.wallet_report(m, facts.drop("chain")), "address"))


def wallet_rows(d: DataFrame) -> DataFrame:
    """Wallets with their facts, for display."""
    known = [F.coalesce(F.col(c) if c in d.columns else F.lit(""), F.lit("")).alias(n) for n, c in (("total_received",) * 2, ("balance",) * 2, ("first_seen", "first_active"), ("last_seen", "last_active"), ("checked_date",) * 2, ("explorer_url",) * 2, ("chainabuse_url",) * 2)]
    return d.select("chain", "address", "times_seen", "distinct_domains", "tx_count", "active", *known, "sample_subjects", "sample_ids", "first")


def transactions(t: DataFrame) -> DataFrame:
    other = C.split_list(F.coalesce("counterparty_addresses", F.lit("")))
    return t.select("address", "chain", "txid", "timestamp", "direction", "amount", other.alias("counterparty_addresses"), "confirmed", F.col("tx_explorer_url").alias("explorer_url"))


def images(m: DataFrame) -> DataFrame:
    """Images by hash.  Likenesses and names are paired with hashes by place, as the table has them: blanks are left out there, so later ones move up."""
    d = m.select("seq", "id", "subject", "from_domain", F.posexplode("image_hashes").alias("at", "hash"), "image_phashes", "image_filenames")
    d = d.withColumns({"phash": F.get("image_phashes", F.col("at")), "file": F.get("image_filenames", F.col("at"))})
    place = F.struct("seq", "at")
    likeness = F.min_by("phash", F.when(F.col("phash").isNotNull(), place))
    g = d.groupBy("hash").agg(F.coalesce(likeness, F.lit("")).alias("phash"), F.count(F.lit(1)).alias("times_seen"), R.domains_of().alias("distinct_domains"), F.min(place).alias("first"))
    names = R.smallest(d.where("file IS NOT NULL"), ["hash"], "file", 4, "filenames").select("hash", "filenames")
    return image_rows(g.join(names, "hash", "left").join(R.samples(d, "hash"), "hash"))


def image_rows(g: DataFrame) -> DataFrame:
    """Images for display, from what was counted of each hash."""
    return g.select("hash", "phash", "times_seen", "distinct_domains", F.coalesce("filenames", F.array().cast("array<string>")).alias("filenames"), "sample_subjects", "sample_ids", "first")


def fingerprints(m: DataFrame, facts: DataFrame | None, safe: bool = True) -> DataFrame:
    """Indicators that sender domains share, made safe, with what makes them strong."""
    return fingerprint_rows(R.operator_fingerprints(m, facts, safe=safe), safe)


def fingerprint_rows(d: DataFrame, safe: bool) -> DataFrame:
    """Shared indicators for display."""
    c = F.col
    value = F.when(c("kind") == "email", _shown(safe, C.defang_email)(c("value"))).when(c("kind") == "ip", _shown(safe, C.defang_ip)(c("value"))).otherwise(c("value"))
    strong = F.when(c("kind").isin("btc", "eth"), "wallet").when(c("kind").isin("image", "ip"), c("kind")).when(c("functional"), "functional").otherwise("filler")
    name = F.when(c("kind").isin("btc", "eth"), F.upper("kind")).otherwise(c("kind"))
    union = F.array_position(F.array(*map(F.lit, ("phone", "email", "btc", "image", "ip"))), F.when(c("kind") == "eth", "btc").otherwise(c("kind")))
    return d.select(name.alias("type"), value.alias("value"), strong.alias("confidence"), "domain_count", F.split("domains", "; ").alias("domains"), "rank", union.alias("branch"), "first")


#: The order of each grouped relation; ``first``, ``first_seq`` and the like only serve the order.
ORDERS = {
    "trends": ["month"], "domains": ["-count", "first_seq"], "registration_clusters": ["-domain_count", "domains"], "asns": ["-messages", "first_seq"], "ips": ["-times_seen", "first_seq"], "template_clusters": ["cluster"],
    "brands": ["-count", "first"], "phones": ["-confidence", "-times_seen", "first"], "contact_emails": ["-confidence", "-times_seen", "first"], "wallets": ["-active", "-times_seen", "first"],
    "images": ["-times_seen", "first"], "fingerprints": ["rank", "-domain_count", "branch", "first"],
}


def row_relations(m: DataFrame, dims: dict[str, DataFrame], safe: bool = True) -> dict[str, tuple[DataFrame, list[str]]]:
    """The relations of one row per message, link, transaction or action, each with its order."""
    return {
        "triage_queue": (triage_queue(m, dims["triage"], safe), ["-scam_score", "-date_iso", "seq"]),
        "wallet_transactions": (transactions(dims["wallet_transactions"]), ["address", "timestamp", "txid"]),
        "emails": (emails(m), ["seq"]),
        "urls": (urls(dims["urls"]), [c for c in ("seq", "position") if c in dims["urls"].columns]),
        "actions": (R.actions(dims["actions"]), ["-date", *[c for c in ("seq",) if c in dims["actions"].columns]]),
    }


def relations(m: DataFrame, dims: dict[str, DataFrame], safe: bool = True) -> dict[str, tuple[DataFrame, list[str]]]:
    """Every relation of the document with its order."""
    facts = dims["ip_enrichment"]
    grouped = {
        "trends": R.trends(m, counted=True), "domains": domains(m, dims["domain_enrichment"]), "registration_clusters": registrations(dims["domain_enrichment"], m), "asns": asns(m, facts), "ips": ips(m, facts, safe),
        "template_clusters": template_clusters(m, safe), "brands": brands(m), "phones": contacts(m, "phone", safe), "contact_emails": contacts(m, "email", safe),
        "wallets": wallets(m, dims["wallet_enrichment"]), "images": images(m), "fingerprints": fingerprints(m, facts, safe),
    }
    return {k: (df, ORDERS[k]) for k, df in grouped.items()} | row_relations(m, dims, safe)


#: Columns that order relations and are not shown in the document.
ORDERING = ("first", "first_seq", "rank", "branch", "seq", "position", "functional")


def document(m: DataFrame, dims: dict[str, DataFrame], generated_at: str, kept: tuple[dict[str, object], dict[str, DataFrame]] | None = None) -> dict[str, object]:
    """Entries of the document under ``KEYS``, for :func:`siftline.sources.tables.json_document`.

    ``kept``: plain numbers and grouped relations, by their keys, that were not
    made of all messages, such as those of ``plans.partials``.
    """
    if kept:
        numbers, own = kept
        return _entries({"generated_at": generated_at} | numbers, {k: (df, ORDERS[k]) for k, df in own.items()} | row_relations(m, dims))
    counts = {r.category: r.n for r in m.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category").collect()}  # a handful of categories
    scalars: dict[str, object] = {"generated_at": generated_at, "message_total": sum(counts.values()), "category_counts": counts, "unenriched_ip_count": R.unenriched_ips(m, dims["ip_enrichment"], blank_counts=False).first()[0]}
    return _entries(scalars, relations(m, dims))


def _entries(scalars: dict[str, object], found: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, object]:
    entries = scalars | {k: (df, order, [*ORDERING, *{"triage_queue": ["date_iso"], "registration_clusters": ["domain_count"]}.get(k, [])]) for k, (df, order) in found.items()}
    return {k: entries[k] for k in KEYS}


#: Sheets of the workbook and their columns, in order (fixed values).
SHEETS = {
    "Summary": ["part", "name", "count"],
    "Triage Queue": ["scam_score", "category", "date", "subject", "from_name", "from_addr", "from_domain", "scam_signals", "id"],
    "Emails": M.COLUMNS,
    "URLs": M.URL_COLUMNS,
    "Domain Clusters": ["domain", "messages", "categories", "registered", "registrar", "sample_subjects", "sample_ids"],
    "Domain Enrichment": ["domain", "registered_date", "registrar", "nameservers", "registrant_org", "registrant_country", "notes"],
    "Registration Clusters": ["registrar", "nameserver_roots", "domains", "domain_count", "dates", "span_days", "messages"],
    "Origin ASNs": ["asn", "as_name", "isp", "countries", "messages", "likely_scam", "ips", "domains", "sample_subjects"],
    "IP Addresses": ["ip", "asn", "as_name", "isp", "country", "times_seen", "distinct_domains", "sample_subjects", "sample_ids"],
    "Template Clusters": ["cluster", "count", "distinct_domains", "categories", "contacts", "sample_subjects", "sample_ids"],
    "Brands": ["brand", "count", "categories", "distinct_domains", "sample_subjects", "sample_ids"],
    "Phone Numbers": ["value", "confidence", "times_seen", "distinct_domains", "sample_subjects", "sample_ids"],
    "Email Addresses": ["value", "confidence", "times_seen", "distinct_domains", "sample_subjects", "sample_ids"],
    "Wallets": ["chain", "address", "times_seen", "distinct_domains", "tx_count", "total_received", "balance", "first_seen", "last_seen", "checked_date", "sample_subjects", "sample_ids"],
    "Wallet Transactions": E.TRANSACTION_COLUMNS,
    "Images": ["hash", "phash", "times_seen", "distinct_domains", "filenames", "sample_subjects", "sample_ids"],
    "Operator Fingerprints": ["type", "value", "confidence", "domain_count", "domains"],
    "Actions Taken": ["date", "action", "target_type", "target", "reference", "status", "notes"],
    "Trends": ["month", "total", "likely_scam", "review", "bulk_marketing", "new_domains", "top_brands"],
}
ARTIFACT = "(likely Exchange version stamp, not a real IP)"


def summary(m: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """``(part, name, count, place)``: categories, repeated senders, totals, and the ten commonest brands."""
    n = F.count(F.lit(1)).alias("count")
    place = F.row_number().over(W.orderBy(F.desc("count"), "first"))  # twenty rows at most
    senders = m.where("from_domain <> ''").groupBy(C.sender_key(F.col("from_domain"), F.col("from_addr")).alias("name")).agg(n, F.min("seq").alias("first")).orderBy(F.desc("count"), "first").limit(20).where("count >= 2")
    top = brands(m).orderBy(F.desc("count"), "first").limit(10)
    order = F.array_position(F.array(*map(F.lit, R.CATEGORIES)), F.col("name")).cast("int")
    totals = [("template clusters", template_clusters(m)), ("operator fingerprints", fingerprints(m, dims["ip_enrichment"])), ("untriaged", R.triage_queue(m, dims["triage"]))]
    out = R.category_counts(m).select(F.lit("category").alias("part"), F.col("category").alias("name"), F.col("messages").alias("count")).withColumn("place", order)
    out = out.unionByName(senders.select(F.lit("sender").alias("part"), "name", "count", place.alias("place")))
    for i, (name, d) in enumerate(totals):
        out = out.unionByName(d.agg(n).select(F.lit("total").alias("part"), F.lit(name).alias("name"), "count", F.lit(i).alias("place")))
    return out.unionByName(top.select(F.lit("brand").alias("part"), F.col("brand").alias("name"), "count", place.alias("place")))


def sheets(m: DataFrame, dims: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """The workbook: each sheet's relation, as it stands and not made safe, with its columns of ``SHEETS``, and its order."""
    d = relations(m, dims, safe=False)
    lead = lambda subjects: F.transform(subjects, lambda x: F.substring(x, 1, 60))
    facts = dims["domain_enrichment"]
    clusters = R.sender_domains(m, by_key=False).join(R.samples(m.where("from_domain <> ''"), "from_domain").select(F.col("from_domain").alias("sender"), "sample_subjects"), "sender")
    known = facts.select(F.col("domain").alias("sender"), F.col("registered_date").alias("registered"), "registrar")
    first = m.where("from_domain <> ''").groupBy(F.col("from_domain").alias("sender")).agg(F.min("seq").alias("first_seq"))
    clusters = clusters.join(known, "sender", "left").join(first, "sender").withColumnRenamed("sender", "domain")
    by = m.where("from_domain <> ''").groupBy(F.col("from_domain").alias("domain")).agg(F.count(F.lit(1)).alias("messages"))
    counted = F.transform("top_brands", lambda x: F.concat(x["brand"], F.lit(" ("), x["count"].cast("string"), F.lit(")")))
    wallets_ = d["wallets"][0]
    chosen = {
        "Summary": (summary(m, dims).withColumn("at", F.array_position(F.array(*map(F.lit, ("category", "sender", "total", "brand"))), F.col("part"))), ["at", "place"]),
        "Triage Queue": d["triage_queue"], "Emails": (m, ["seq"]), "URLs": (dims["urls"], [c for c in ("seq", "position") if c in dims["urls"].columns]),
        "Domain Clusters": (clusters, ["-messages", "first_seq"]), "Domain Enrichment": (facts, ["domain"]),
        "Registration Clusters": (R.registration_clusters(facts, by).withColumn("dates", F.array_join("dates", ", ")), ["-domain_count", "domains"]),
        "Origin ASNs": (d["asns"][0].withColumnsRenamed({"distinct_ips": "ips", "distinct_domains": "domains"}).withColumn("countries", F.array_join("countries", ", ")), ["-messages", "first_seq"]),
        "IP Addresses": (d["ips"][0].withColumn("asn", F.when(F.col("artifact"), ARTIFACT).otherwise(F.col("asn"))), d["ips"][1]),
        "Template Clusters": (d["template_clusters"][0].withColumn("categories", F.array_join("categories", ", ")), ["cluster"]),
        "Brands": (d["brands"][0].withColumn("categories", F.array_join("categories", ", ")), d["brands"][1]), "Phone Numbers": d["phones"], "Email Addresses": d["contact_emails"],
        "Wallets": (wallets_, ["-tx_count", "-times_seen", "first"]), "Wallet Transactions": (dims["wallet_transactions"], ["address", "timestamp", "txid"]),
        "Images": d["images"], "Operator Fingerprints": d["fingerprints"], "Actions Taken": (dims["actions"], d["actions"][1]),
        "Trends": (d["trends"][0].withColumn("top_brands", F.array_join(counted, ", ")), ["month"]),
    }
    joined = {"sample_subjects": lambda x: F.array_join(lead(x), " | "), "sample_ids": lambda x: F.array_join(x, ", ")}
    out = {}
    for name, (df, order) in chosen.items():
        df = df.withColumns({c: f(F.col(c)) for c, f in joined.items() if dict(df.dtypes).get(c) == "array<string>"})
        out[name] = (df, order)
    return out


def write_sheets(m: DataFrame, dims: dict[str, DataFrame], write: Callable[[str, DataFrame], object]) -> None:
    """Pass each sheet to ``write`` by its name, in order, sorted and as text."""
    for name, (df, order) in sheets(m, dims).items():
        keys = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
        write(name, tables.flat((df.orderBy(*keys) if keys else df).select(*SHEETS[name])))


def sheet_rows(m: DataFrame, dims: dict[str, DataFrame]) -> Iterator[tuple[str, list[str], Iterator[tuple]]]:
    """Each sheet with its columns and rows, for :func:`siftline.sources.workbook.write`: whole numbers, and text; a partition at a time comes to the driver."""
    for name, (df, order) in sheets(m, dims).items():
        keys = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
        d = (df.orderBy(*keys) if keys else df).select(*SHEETS[name])
        numbers = [c for c, kind in d.dtypes if kind in ("int", "bigint")]
        text = d.select(*[c for c in d.columns if c not in numbers])
        shown = tables.flat_columns(text)
        rows = d.select(*[F.col(f"`{c}`") if c in numbers else shown[c] for c in d.columns])
        yield name, SHEETS[name], (tuple(r) for r in rows.toLocalIterator())


def kpis(m: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """One row of headline numbers."""
    n = F.count(F.lit(1))
    w = E.wallet_report(m, dims["wallet_enrichment"].drop("chain"))
    parts = [
        m.agg(n.alias("messages"), F.count(F.when(F.col("category") == "likely_scam", 1)).alias("likely_scam")),
        w.agg(n.alias("wallets"), F.count(F.when(F.col("active"), 1)).alias("active_wallets")),
        R.operator_fingerprints(m, dims.get("ip_enrichment")).agg(n.alias("fingerprints")),
        R.triage_queue(m, dims["triage"]).agg(n.alias("untriaged")),
        dims["actions"].agg(n.alias("actions"), F.countDistinct("target").alias("action_targets")),
    ]
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  single rows, joined on a constant
    out = one(parts[0])
    for p in parts[1:]:
        out = out.join(one(p), "_one")
    return out.drop("_one")


def run_steps(steps: dict[str, Callable[[], object]], skip: tuple[str, ...] = (), isolated: tuple[str, ...] = ()) -> dict[str, str]:
    """Steps in order; a failure ends the run, but one of ``isolated`` steps is noted and the run goes on."""
    said: dict[str, str] = {}
    for name, step in steps.items():
        if name in skip:
            said[name] = "skipped"
            continue
        try:
            step()
            said[name] = "done"
        except Exception as e:  # noqa: BLE001  noted, or raised
            if name not in isolated:
                raise
            said[name] = f"failed: {type(e).__name__}: {e}"
    return said
