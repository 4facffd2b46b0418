"""Registered queries of the whole report's relations, each with its SQL.

They read the message view of ``queries``; list columns are joined by ``"; "``,
and ``place`` is the row's place in the order of the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators import scratch
from siftline.operators.graph import numbered
from siftline.operators.triage import triage
from siftline.plans import enrichment as E
from siftline.plans import messages as M
from siftline.plans import relations as R
from siftline.plans import partials, report
from siftline.queries import _WALLETS, DOMAINS, DUCK, DUCK_IPS, FREE, SQL, ip_table, messages, query, table

SAMPLES = "array_to_string(list(substr(subject, 1, 80) ORDER BY seq)[1:4], '; ') AS sample_subjects, array_to_string(list(id ORDER BY seq)[1:6], '; ') AS sample_ids"
KINDS = (("phone", "phone", "phone_functional", 0), ("email", "email", "email_functional", 1), ("btc", "btc", "false", 2), ("image", "image", "false", 3), ("ip", "ip", "false", 4))
INDICATORS = ", x AS (" + " UNION ALL ".join(f"SELECT m.*, '{k}' AS kind, {c} AS value, {f} AS functional, {n} AS branch FROM m WHERE {c} <> ''" for k, c, f, n in KINDS) + ")\n"
DOMAIN_COUNT = "count(DISTINCT nullif(from_domain, ''))"
SAFE_EMAIL = "regexp_replace(value, '^(.*)@([^@]*)$', '\\1[@]') || replace(regexp_extract(value, '^(.*)@([^@]*)$', 2), '.', '[.]')"


def ranked(df: DataFrame, order: list[str], drop: tuple[str, ...] = report.ORDERING) -> DataFrame:
    """With lists joined and ``place``, without the columns that only order."""
    df = numbered(df, [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order], "place", 1).drop(*drop)
    return df.select(*[F.array_join(c, "; ").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes])


def dims(spark, sf_dir) -> dict[str, DataFrame]:
    done = table(spark, sf_dir, "labels").select(F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 10).alias("id"))
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("target"))
    return {
        "ip_enrichment": ip_table(spark, sf_dir), "domain_enrichment": spark.sql(DOMAINS, supplier=table(spark, sf_dir, "supplier")), "triage": done, "actions": log,
        "wallet_enrichment": spark.sql(_WALLETS, supplier=table(spark, sf_dir, "supplier")),
    }


def _contacts(kind: str, shown: str, name: str):
    sql = DUCK + INDICATORS + f"""SELECT {shown} AS value, CASE WHEN bool_or(functional) THEN 'functional' ELSE 'filler' END AS confidence, count(*) AS times_seen, {DOMAIN_COUNT} AS distinct_domains, {SAMPLES},
row_number() OVER (ORDER BY bool_or(functional) DESC, count(*) DESC, min(seq)) AS place FROM x WHERE kind = '{kind}' GROUP BY value"""

    def run(spark, sf_dir):
        return ranked(report.contacts(messages(spark, sf_dir), kind), ["-confidence", "-times_seen", "first"])

    run.__name__ = name
    query(sql)(run)


_contacts("phone", "value", "phone_report")
_contacts("email", SAFE_EMAIL, "contact_report")


@query(DUCK + f"""SELECT brand, count(*) AS count, string_agg(DISTINCT category, '; ' ORDER BY category) AS categories, {DOMAIN_COUNT} AS distinct_domains, {SAMPLES}, row_number() OVER (ORDER BY count(*) DESC, min(seq * 10 + pos)) AS place
FROM (SELECT *, brand1 AS brand, 0 AS pos FROM m UNION ALL SELECT *, brand2, 1 FROM m) WHERE brand <> '' GROUP BY brand""")
def brand_report(spark, sf_dir):
    return ranked(report.brands(messages(spark, sf_dir)), ["-count", "first"])


@query(DUCK + f"""SELECT image AS hash, coalesce(min(CASE WHEN seq % 2 = 0 THEN 'p' || image END), '') AS phash, count(*) AS times_seen, {DOMAIN_COUNT} AS distinct_domains,
array_to_string(list_sort(list(DISTINCT 'f' || (seq % 6)::VARCHAR || '.png'))[1:4], '; ') AS filenames, {SAMPLES}, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM m WHERE image <> '' GROUP BY image""")
def image_report(spark, sf_dir):
    return ranked(report.images(messages(spark, sf_dir)), ["-times_seen", "first"])


@query(DUCK + DUCK_IPS + f"""SELECT asn, arg_min(as_name, m.ip) AS as_name, arg_min(as_name, m.ip) AS isp, string_agg(DISTINCT country, '; ' ORDER BY country) AS countries, count(*) AS messages, count(*) FILTER (category = 'likely_scam') AS likely_scam,
count(DISTINCT m.ip) AS distinct_ips, {DOMAIN_COUNT} AS distinct_domains, {SAMPLES}, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM m JOIN ips ON m.ip = ips.ip WHERE asn <> '' GROUP BY asn""")
def asn_report(spark, sf_dir):
    return ranked(report.asns(messages(spark, sf_dir), ip_table(spark, sf_dir)), ["-messages", "first_seq"])


#: The same addresses moved to a network of which some are version stamps of a mail exchange.
_STAMPED = "CASE WHEN ip LIKE '8.8.%.1' OR ip LIKE '8.8.%.6' THEN '15.' || substr(ip, 3) ELSE ip END"
_STAMPED_IPS = f"SELECT {_STAMPED} AS ip, CASE WHEN ip LIKE '8.8.%.1' THEN '' ELSE asn END AS asn, as_name, CASE WHEN ip LIKE '8.8.%.1' OR ip LIKE '8.8.%.6' THEN 'HP Inc.' ELSE as_name END AS isp, country FROM ips"


def stamped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Messages and address facts, with some addresses of origin that are artifacts."""
    m = messages(spark, sf_dir).withColumn("ip", F.expr(_STAMPED))
    m = m.withColumn("indicators", F.transform("indicators", lambda x: F.when(x["kind"] == "ip", x.withField("value", F.col("ip"))).otherwise(x)))
    ip_table(spark, sf_dir).createOrReplaceTempView("siftline_ips")
    return m, spark.sql(_STAMPED_IPS.replace("FROM ips", "FROM siftline_ips"))


@query(DUCK + DUCK_IPS + f", f AS ({_STAMPED_IPS}), s AS (SELECT * REPLACE ({_STAMPED} AS ip) FROM m WHERE ip <> '')" + f"""
SELECT replace(s.ip, '.', '[.]') AS ip, coalesce(any_value(asn), '') AS asn, coalesce(any_value(as_name), '') AS as_name, coalesce(any_value(isp), '') AS isp, coalesce(any_value(country), '') AS country, count(*) AS times_seen, {DOMAIN_COUNT} AS distinct_domains,
s.ip LIKE '15.%' AND coalesce(any_value(isp), '') = 'HP Inc.' AND coalesce(any_value(asn), '') = '' AS artifact, {SAMPLES}, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM s LEFT JOIN f ON s.ip = f.ip GROUP BY s.ip""")
def ip_details(spark, sf_dir):
    m, facts = stamped(spark, sf_dir)
    return ranked(report.ips(m, facts), ["-times_seen", "first_seq"])


@query(DUCK + DUCK_IPS + f", f AS ({_STAMPED_IPS}), s AS (SELECT * REPLACE ({_STAMPED} AS ip) FROM m)" + INDICATORS.replace("FROM m ", "FROM s ").replace("m.*", "s.*") + f""",
y AS (SELECT x.* FROM x LEFT JOIN f ON x.kind = 'ip' AND x.value = f.ip WHERE NOT coalesce(x.value LIKE '15.%' AND f.isp = 'HP Inc.' AND f.asn = '', false) AND from_domain <> ''),
g AS (SELECT kind, value, branch, bool_or(functional) AS fn, list_sort(list(DISTINCT replace(from_domain, '.', '[.]'))) AS a, min(seq) AS first FROM y GROUP BY kind, value, branch),
r AS (SELECT *, CASE WHEN kind IN ('btc', 'ip') THEN 0 WHEN kind = 'image' OR fn THEN 1 ELSE 2 END AS rank FROM g WHERE len(a) >= 2)
SELECT CASE WHEN kind = 'btc' THEN 'BTC' ELSE kind END AS type, CASE kind WHEN 'email' THEN {SAFE_EMAIL} WHEN 'ip' THEN replace(value, '.', '[.]') ELSE value END AS value,
CASE WHEN kind = 'btc' THEN 'wallet' WHEN kind IN ('image', 'ip') THEN kind WHEN fn THEN 'functional' ELSE 'filler' END AS confidence, len(a)::BIGINT AS domain_count, array_to_string(a[1:8], '; ') AS domains,
row_number() OVER (ORDER BY rank, len(a) DESC, branch, first) AS place FROM r""")
def fingerprint_report(spark, sf_dir):
    return ranked(report.fingerprints(*stamped(spark, sf_dir)), ["rank", "-domain_count", "branch", "first"])


@query(DUCK + f""", d AS ({DOMAINS.format(supplier="supplier")}), g AS (SELECT CASE WHEN from_domain IN ({FREE}) AND from_addr <> '' THEN lower(trim(from_addr)) ELSE from_domain END AS value, count(*) AS count,
string_agg(DISTINCT category, '; ' ORDER BY category) AS categories, arg_min(from_domain, seq) AS provider, {SAMPLES}, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM m WHERE from_domain <> '' GROUP BY 1)
SELECT CASE WHEN value LIKE '%@%' THEN {SAFE_EMAIL} ELSE replace(value, '.', '[.]') END AS domain, value LIKE '%@%' AS is_freemail_address, CASE WHEN value LIKE '%@%' THEN replace(provider, '.', '[.]') ELSE '' END AS provider, count, categories,
coalesce(registered_date, '') AS registered, coalesce(registrar, '') AS registrar, replace(coalesce(nameservers, ''), '.', '[.]') AS nameservers, '' AS registrant_org, '' AS registrant_country, '' AS notes, registrar IS NOT NULL AS enriched,
sample_subjects, sample_ids, place FROM g LEFT JOIN d ON provider = domain""")
def domain_report(spark, sf_dir):
    return ranked(report.domains(messages(spark, sf_dir), dims(spark, sf_dir)["domain_enrichment"]), ["-count", "first_seq"])


@query(DUCK + ", dom AS (" + DOMAINS.format(supplier="supplier") + """), n AS (SELECT from_domain, count(*) AS messages FROM m GROUP BY 1)
SELECT lower(registrar) AS registrar, 'host' || regexp_extract(nameservers, 'host([0-9])', 1) || '[.]net' AS nameserver_roots, count(*) AS domain_count, replace(string_agg(domain, '; ' ORDER BY domain), '.', '[.]') AS domains,
string_agg(registered_date, '; ' ORDER BY registered_date) AS registration_dates, date_diff('day', min(registered_date)::DATE, max(registered_date)::DATE) AS span_days, sum(coalesce(messages, 0))::BIGINT AS messages FROM dom LEFT JOIN n ON domain = from_domain GROUP BY 1, 2 HAVING count(*) >= 2""")
def registration_report(spark, sf_dir):
    d = report.registrations(dims(spark, sf_dir)["domain_enrichment"], messages(spark, sf_dir))
    return ranked(d, ["-domain_count", "domains"]).drop("place")


@query(DUCK + """, d AS (SELECT *, CASE WHEN date_iso = '' THEN '20' || (10 + seq % 15)::VARCHAR || '-01' ELSE substr(date_iso, 1, 7) END AS mon FROM m),
f AS (SELECT mon, count(*) AS new_domains FROM (SELECT from_domain, min(mon) AS mon FROM d WHERE from_domain <> '' GROUP BY 1) GROUP BY 1),
b AS (SELECT mon, brand, count(*) AS n, min(seq * 10 + pos) AS fst FROM (SELECT mon, seq, brand1 AS brand, 0 AS pos FROM d UNION ALL SELECT mon, seq, brand2, 1 FROM d) WHERE brand <> '' GROUP BY 1, 2),
t AS (SELECT mon, string_agg(brand || ' ' || n::VARCHAR, ', ' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY mon ORDER BY n DESC, fst) AS r FROM b) WHERE r <= 3 GROUP BY 1)
SELECT d.mon AS month, count(*) AS total, count(*) FILTER (category = 'likely_scam') AS likely_scam, count(*) FILTER (category = 'review') AS review, count(*) FILTER (category = 'bulk_marketing') AS bulk_marketing,
coalesce(any_value(f.new_domains), 0) AS new_domains, coalesce(any_value(top), '') AS top_brands FROM d LEFT JOIN f ON d.mon = f.mon LEFT JOIN t ON d.mon = t.mon GROUP BY d.mon""")
def trend_report(spark, sf_dir):
    """Months of raw dates too, and the brands with their counts."""
    m = messages(spark, sf_dir)
    d = R.trends(m.withColumn("month", M.month(F.col("date_iso"), F.col("date"))), counted=True)
    return d.withColumn("top_brands", F.array_join(F.transform("top_brands", lambda x: F.concat_ws(" ", x["brand"], x["count"].cast("string"))), ", "))


@query(DUCK + """SELECT id, category, scam_score, CASE WHEN date_iso = '' THEN 'Mon, 01 Jan 20' || (10 + seq % 15)::VARCHAR || ' 10:00:00 +0000' ELSE date_iso END AS date, subject, 'Name ' || (seq % 8)::VARCHAR AS from_name,
split_part(from_addr, '@', 1) || '[@]' || replace(split_part(from_addr, '@', 2), '.', '[.]') AS from_addr, replace(from_domain, '.', '[.]') AS from_domain, 'dmarc=fail; rule ' || (seq % 4)::VARCHAR AS scam_signals,
row_number() OVER (ORDER BY scam_score DESC, date_iso DESC, seq) AS place FROM m WHERE category IN ('likely_scam', 'review') AND id NOT IN (SELECT substr(sha1(cast(doc_id AS string)), 1, 10) FROM labels)""")
def triage_report(spark, sf_dir):
    return ranked(report.triage_queue(messages(spark, sf_dir), dims(spark, sf_dir)["triage"]), ["-scam_score", "-date_iso", "seq"]).drop("date_iso")


@query(DUCK + """SELECT id, 'box' || (seq % 3)::VARCHAR AS source, category, scam_score, 'dmarc=fail; rule ' || (seq % 4)::VARCHAR AS scam_signals, CASE WHEN date_iso = '' THEN 'Mon, 01 Jan 20' || (10 + seq % 15)::VARCHAR || ' 10:00:00 +0000' ELSE date_iso END AS date,
subject, 'Name ' || (seq % 8)::VARCHAR AS from_name, split_part(from_addr, '@', 1) || '[@]' || replace(split_part(from_addr, '@', 2), '.', '[.]') AS from_addr, replace(from_domain, '.', '[.]') AS from_domain,
CASE WHEN seq % 4 = 0 THEN 'me.too[@]gmail[.]com' ELSE '' END AS reply_to_addr, CASE WHEN seq % 3 = 0 THEN 'fail' ELSE 'pass' END AS dkim, '' AS spf, 'none' AS dmarc, replace(ip, '.', '[.]') AS origin_ip, (seq % 3)::INT AS url_count,
'a[.]example; b[.]example' AS url_domains, 'hxxps[://]a[.]example/x[.]' || (seq % 5)::VARCHAR AS first_url, concat_ws('; ', nullif(brand1, ''), nullif(brand2, '')) AS impersonated_brands, phone AS phone_numbers, btc AS wallets,
CASE WHEN email = '' THEN '' ELSE split_part(email, '@', 1) || '[@]' || replace(split_part(email, '@', 2), '.', '[.]') END AS contact_emails, 'p[.]com => ' || replace(from_domain, '.', '[.]') AS link_mismatches, 'shortener:bit.ly' AS url_flags,
(CASE WHEN image = '' THEN 0 ELSE 1 END)::INT AS image_count, row_number() OVER (ORDER BY seq) AS place FROM m""")
def email_report(spark, sf_dir):
    return ranked(report.emails(messages(spark, sf_dir)), ["seq"])


@query(DUCK + ", w AS (" + _WALLETS.format(supplier="supplier") + f""")
SELECT 'BTC' AS chain, m.btc AS address, count(*) AS times_seen, {DOMAIN_COUNT} AS distinct_domains, coalesce(any_value(tx_count)::INT, 0) AS tx_count, coalesce(any_value(tx_count)::INT, 0) > 0 AS active, '' AS total_received, coalesce(any_value(balance), '') AS balance,
'' AS first_seen, '' AS last_seen, '' AS checked_date, '' AS explorer_url, '' AS chainabuse_url, {SAMPLES}, row_number() OVER (ORDER BY coalesce(any_value(tx_count)::INT, 0) > 0 DESC, count(*) DESC, min(seq)) AS place
FROM m LEFT JOIN w ON m.btc = w.address WHERE m.btc <> '' GROUP BY m.btc""")
def wallet_details(spark, sf_dir):
    return ranked(report.wallets(messages(spark, sf_dir), dims(spark, sf_dir)["wallet_enrichment"]), ["-active", "-times_seen", "first"])


@query(DUCK + f""", t AS (SELECT *, seq % 9 * 286331153 AS fp FROM m WHERE seq % 9 <> 0), n AS (SELECT DISTINCT fp FROM t),
e AS (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON bit_count(xor(a.fp, b.fp)) <= 3),
g AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS fp, min(b) AS c FROM r GROUP BY a),
q AS (SELECT t.*, c FROM t JOIN g ON t.fp = g.fp), k AS (SELECT c, string_agg(DISTINCT v, '; ' ORDER BY v) AS contacts FROM (SELECT c, replace(email, '@mail.', '[@]mail[.]') AS v FROM q WHERE email <> '' AND email_functional UNION ALL SELECT c, phone FROM q WHERE phone <> '' AND phone_functional) GROUP BY c)
SELECT row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS cluster, count(*) AS count, {DOMAIN_COUNT} AS distinct_domains, string_agg(DISTINCT category, '; ' ORDER BY category) AS categories, coalesce(any_value(contacts), '') AS contacts, {SAMPLES}
FROM q LEFT JOIN k ON q.c = k.c GROUP BY q.c HAVING count(*) >= 2""")
def template_report(spark, sf_dir):
    return ranked(report.template_clusters(messages(spark, sf_dir)), ["cluster"]).drop("place")


@query(DUCK + DUCK_IPS + INDICATORS + ", w AS (" + _WALLETS.format(supplier="supplier") + """), g AS (SELECT kind, value FROM x WHERE from_domain <> '' GROUP BY 1, 2 HAVING count(DISTINCT from_domain) >= 2)
SELECT count(*) AS messages, count(*) FILTER (category = 'likely_scam') AS likely_scam, count(DISTINCT nullif(btc, '')) AS wallets, (SELECT count(DISTINCT btc) FROM m JOIN w ON btc = address WHERE tx_count::INT > 0) AS active_wallets, (SELECT count(*) FROM g) AS fingerprints,
count(*) FILTER (category IN ('likely_scam', 'review') AND id NOT IN (SELECT substr(sha1(cast(doc_id AS string)), 1, 10) FROM labels)) AS untriaged, (SELECT count(*) FROM orders) AS actions, (SELECT count(DISTINCT o_custkey) FROM orders) AS action_targets FROM m""")
def kpi_report(spark, sf_dir):
    return report.kpis(messages(spark, sf_dir), dims(spark, sf_dir))


# The same relations from partial counts of three batches, added one after the other and merged.


def _batched(m: DataFrame, templates: bool = False) -> dict[str, DataFrame]:
    kept = partials.ReportPartials(m.sparkSession, scratch.place(m.sparkSession, "partials"), templates)
    for n in range(3):
        kept.add(m.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == n), f"b{n}")
    return kept.tables()


def _by_batches(name: str, made, order: list[str], *hidden: str) -> None:
    def run(spark, sf_dir):
        return ranked(made(spark, sf_dir), order).drop(*hidden)

    run.__name__ = f"{name}_by_batches"
    query(SQL[name])(run)


def _trends_by_batches(spark, sf_dir):
    m = messages(spark, sf_dir)
    d = partials.trends(_batched(m.withColumn("month", M.month(F.col("date_iso"), F.col("date")))))
    return d.withColumn("top_brands", F.array_join(F.transform("top_brands", lambda x: F.concat_ws(" ", x["brand"], x["count"].cast("string"))), ", "))


def _fingerprints_by_batches(spark, sf_dir):
    m, facts = stamped(spark, sf_dir)
    return partials.fingerprints(_batched(m), facts)


_by_batches("domain_report", lambda spark, sf: partials.domains(_batched(messages(spark, sf)), dims(spark, sf)["domain_enrichment"]), report.ORDERS["domains"])
_by_batches("asn_report", lambda spark, sf: partials.asns(_batched(messages(spark, sf)), ip_table(spark, sf)), report.ORDERS["asns"])
_by_batches("template_report", lambda spark, sf: partials.template_clusters(_batched(messages(spark, sf), True)), report.ORDERS["template_clusters"], "place")
_by_batches("brand_report", lambda spark, sf: partials.brands(_batched(messages(spark, sf))), report.ORDERS["brands"])
_by_batches("contact_report", lambda spark, sf: partials.contacts(_batched(messages(spark, sf)), "email"), report.ORDERS["contact_emails"])
_by_batches("wallet_details", lambda spark, sf: partials.wallets(_batched(messages(spark, sf)), dims(spark, sf)["wallet_enrichment"]), report.ORDERS["wallets"])
_by_batches("image_report", lambda spark, sf: partials.images(_batched(messages(spark, sf))), report.ORDERS["images"])
_by_batches("fingerprint_report", _fingerprints_by_batches, report.ORDERS["fingerprints"])
_by_batches("trend_report", _trends_by_batches, report.ORDERS["trends"], "place")


_AGES = """SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN 'evil.top' WHEN 1 THEN 'mail.evil.top' ELSE 'a.gov.br' END AS from_domain, CASE doc_id % 5 WHEN 0 THEN 'mail.yahoo.com' WHEN 1 THEN 'x.evil.top' ELSE '' END AS reply_domain,
'none' AS dmarc, '' AS spf, '' AS dkim, 'hello' AS subject, CASE WHEN doc_id % 7 = 0 THEN 'please act now or now' WHEN doc_id % 7 = 1 THEN 'it''s suspended' ELSE 'nothing' END AS body, CASE doc_id % 11 WHEN 0 THEN 'Bank holiday of North America' WHEN 1 THEN 'Aflac for AARP' ELSE '' END AS display_name,
CASE WHEN doc_id % 2 = 0 THEN cast(doc_id % 13 * 30 AS int) END AS age, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN cast(doc_id % 13 * 30 AS int) WHEN doc_id % 4 < 2 THEN cast(doc_id % 17 * 25 AS int) END AS root_age, 0 AS n_mismatch, 0 AS n_wallets, false AS list_unsubscribe, doc_id FROM {documents}"""


@query("WITH s AS (" + _AGES.format(documents="documents") + """), t AS (SELECT *, CASE WHEN age <> 0 THEN age ELSE root_age END AS a FROM s),
r AS (SELECT seq, list_filter([CASE WHEN body LIKE '%act now%' THEN 'urgent keyword: ''act now''' WHEN body LIKE '%suspended%' THEN 'urgent keyword: ''suspended''' END, CASE WHEN display_name LIKE 'Aflac%' THEN 'display name claims AARP, sent from ' || from_domain END,
CASE WHEN reply_domain = 'mail.yahoo.com' THEN 'reply-to diverted to freemail (mail.yahoo.com)' WHEN reply_domain = 'x.evil.top' AND from_domain = 'a.gov.br' THEN 'reply-to domain (x.evil.top) != from domain' END,
CASE WHEN a < 365 THEN 'sender domain registered ' || a::VARCHAR || ' days ago' END], lambda x: x IS NOT NULL) AS reasons,
(CASE WHEN body LIKE '%act now%' OR body LIKE '%suspended%' THEN 3 ELSE 0 END) + (CASE WHEN display_name LIKE 'Aflac%' THEN 3 ELSE 0 END) + (CASE WHEN reply_domain = 'mail.yahoo.com' THEN 2 WHEN reply_domain = 'x.evil.top' AND from_domain = 'a.gov.br' THEN 1 ELSE 0 END)
+ (CASE WHEN a < 90 THEN 3 WHEN a < 365 THEN 1 ELSE 0 END) AS points FROM t)
SELECT seq, array_to_string(reasons, '; ') AS reasons, points::INT AS scam_score, CASE WHEN points >= 3 THEN 'likely_scam' ELSE 'review' END AS category FROM r""")
def triage_reasons(spark, sf_dir):
    """Ages of 0 and of roots, free mail on subdomains, the first urgent phrase, and claims of brands: with the texts of the reasons."""
    s = spark.sql(_AGES, documents=table(spark, sf_dir, "documents")).withColumn("flags", F.array().cast("array<string>"))
    return triage(s).select("seq", F.array_join("scam_signals", "; ").alias("reasons"), "scam_score", "category")


@query("""SELECT lower(c_name) AS domain, date_diff('day', DATE '2020-01-01' + (c_custkey % 400)::INT, DATE '2024-01-01') AS age FROM customer WHERE c_custkey % 3 <> 0""")
def domain_ages(spark, sf_dir):
    day = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'unknown 2020-13-40' ELSE concat('registered ', cast(date_add(DATE '2020-01-01', cast(c_custkey % 400 as int)) as string), 'T00:00') END")
    facts = table(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"), day.alias("registered_date"))
    return E.domain_ages(facts, F.lit("2024-01-01").cast("date")).withColumn("age", F.col("age").cast("long"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey % 40 AS n, o_orderkey % 7 AS r FROM orders)
SELECT CASE WHEN r < 4 THEN 'BTC' ELSE 'ETH' END AS chain, 'a' || k::VARCHAR AS address, CASE WHEN r = 6 THEN '' ELSE n::VARCHAR END AS tx_count,
CASE WHEN r >= 4 OR r = 6 THEN '' WHEN n = 0 THEN '0' ELSE n::VARCHAR || '.00000001 BTC' END AS total_received, CASE WHEN r = 6 THEN '' WHEN n = 0 THEN '0' WHEN r < 4 THEN n::VARCHAR || '.00000000 BTC' ELSE n::VARCHAR || '.500000 ETH' END AS balance,
CASE WHEN r < 4 AND n > 0 THEN (CASE WHEN n > 25 THEN '<= ' ELSE '' END) || '2020-09-13' ELSE '' END AS first_seen, CASE WHEN r < 4 AND n > 0 THEN '2020-09-14' ELSE '' END AS last_seen FROM d WHERE r <> 5""")
def wallet_answers(spark, sf_dir):
    """Answers about wallets as rows: counts, sums, first and last days, rejected and failed ones."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey % 40 n", "o_orderkey % 7 r")
    btc = F.expr("""to_json(named_struct('info', named_struct('chain_stats', named_struct('tx_count', n, 'funded_txo_sum', CASE WHEN n = 0 THEN 0L ELSE n * 100000000L + 1 END, 'spent_txo_sum', CASE WHEN n = 0 THEN 0L ELSE 1L END)),
      'recent', array(named_struct('status', named_struct('confirmed', true, 'block_time', 1600041600L)), named_struct('status', named_struct('confirmed', true, 'block_time', 1600000000L)), named_struct('status', named_struct('confirmed', false, 'block_time', 5L)))))""")
    eth = F.expr("""to_json(named_struct('info', named_struct('coin_balance', CASE WHEN n = 0 THEN '0' ELSE concat(n, '500000000000000000') END), 'counters', named_struct('transactions_count', cast(n as string))))""")
    error = F.expr("CASE r WHEN 5 THEN 'URLError: down' WHEN 6 THEN 'HTTPError: HTTP Error 400: Bad Request' END")
    answers = o.select(F.expr("concat(CASE WHEN r < 4 THEN 'BTC:a' ELSE 'ETH:a' END, k)").alias("wallet"), F.when(F.col("r") < 4, btc).when(F.col("r") == 4, eth).alias("answer"), error.alias("error"))
    return E.wallet_rows(answers, "2024-01-01").select("chain", "address", "tx_count", "total_received", "balance", "first_seen", "last_seen")


@query("""SELECT c_name AS domain, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2020-01-02' END AS registered_date, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'R' || c_nationkey::VARCHAR END AS registrar, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a.x; b' || c_nationkey::VARCHAR || '.x' END AS nameservers,
CASE WHEN c_custkey % 4 = 0 THEN 'Bad Request -- WHOIS lookup failed: No match: x' ELSE '' END AS notes FROM customer WHERE c_custkey % 5 <> 0""")
def whois_answers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    answer = F.expr("to_json(named_struct('creation_date', array('2020-01-02', '2021-01-01'), 'registrar', array(concat('R', c_nationkey)), 'name_servers', array(concat('B', c_nationkey, '.x.'), 'a.x', 'A.X')))")
    error = F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'TimeoutError: x' WHEN c_custkey % 4 = 0 THEN 'PywhoisError: No match: x' END")
    a = c.select(F.col("c_name").alias("domain"), F.when(error.isNull(), answer).alias("answer"), error.alias("error"))
    return E.domain_rows(a).unionByName(E.failed_domains(a)).select("domain", "registered_date", "registrar", "nameservers", "notes")
