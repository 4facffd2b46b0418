"""Enrichment of domains, addresses of origin and wallets: candidates, lookups, answers as rows, and upserts.

Services are reached through a client that the caller passes in; everything
else is native.  A client is a function from a list of keys to a list of
answers, JSON texts in the order of the keys; ``None`` is a key to ask again in
the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import columns as C

BTC_TRANSACTION = (
    "struct<txid: string, status: struct<confirmed: boolean, block_time: long, block_height: long>,"
    " vin: array<struct<prevout: struct<scriptpubkey_address: string, value: decimal(38,0)>>>, vout: array<struct<scriptpubkey_address: string, value: decimal(38,0)>>>"
)
ETH_TRANSACTION = "struct<hash: string, `from`: struct<hash: string>, `to`: struct<hash: string>, value: string, timestamp: string, block_number: long, block: long, status: string>"
IP_ANSWER = "struct<query: string, status: string, country: string, countryCode: string, isp: string, org: string, `as`: string, asname: string, reverse: string>"
TRANSACTION_COLUMNS = "address chain txid timestamp block_height direction amount counterparty_addresses confirmed tx_explorer_url".split()


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as text in UTC, whatever the session's zone."""
    whole = F.timestamp_seconds(epoch).cast("timestamp")
    return F.date_format(F.to_utc_timestamp(whole, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_rows(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key: the values of the last one, with the ``seq`` of the first."""
    values = [c for c in df.columns if c not in (*keys, seq)]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_v"), F.min(seq).alias(seq))
    return g.select(*keys, *[F.col("_v")[c].alias(c) for c in values], seq)


# Candidates


def candidate_domains(m: DataFrame, at_least: int = 1) -> DataFrame:
    """Sender domains of at least so many messages."""
    return m.where("from_domain <> ''").groupBy(F.col("from_domain").alias("domain")).agg(F.count(F.lit(1)).alias("messages")).where(F.col("messages") >= at_least)


def candidate_ips(m: DataFrame) -> DataFrame:
    """``(ip, first_seq)``: all global addresses of ``originating_ips``, not only those of origin."""
    return m.select("seq", F.explode("originating_ips").alias("ip")).where(C.is_global_ip(F.col("ip"))).groupBy("ip").agg(F.min("seq").alias("first_seq"))


def candidates(m: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct indicator values of these kinds, with where each was first seen."""
    seen = m.select("seq", F.inline("indicators")).where(F.col("kind").isin(kinds))
    return seen.groupBy("kind", "value").agg(F.min("seq").alias("first_seq"))


def to_look_up(found: DataFrame, known: DataFrame, key: str, recheck: bool = False, limit: int = 0, order: str | None = None) -> DataFrame:
    """Candidates that ``known`` lacks, or all of them; the first ``limit`` by ``order``, where 0 is no limit."""
    d = found if recheck else found.join(known.select(key), key, "left_anti")
    return d.orderBy(order or key).limit(limit) if limit else d


def without_nameservers(known: DataFrame) -> DataFrame:
    return known.where(F.trim(F.coalesce("nameservers", F.lit(""))) == "")


# Lookups


def look_up(keys: DataFrame, key: str, client: Callable[[list[str]], list[str | None]], batch: int = 100, delay: float = 0) -> DataFrame:
    """``(key, answer, error)``: asks in batches; a batch that fails keeps its rows, with ``error`` set and no answer.

    Every task asks on its own, with ``delay`` seconds between two of its
    batches: a service that limits its callers wants ``keys`` in one partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked_before = False
        for f in frames:
            for at in range(0, len(f), batch):
                if asked_before:
                    time.sleep(delay)
                asked_before = True
                asked = f[key].iloc[at : at + batch].tolist()
                try:
                    answers, error = list(client(asked)), None
                    if len(answers) != len(asked):
                        raise ValueError(f"{len(answers)} answers to {len(asked)} keys")
                except Exception as e:  # noqa: BLE001  the rows say what went wrong
                    answers, error = [None] * len(asked), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: asked, "answer": pd.Series(answers, dtype=object), "error": pd.Series([error] * len(asked), dtype=object)})

    return keys.select(F.col(key).cast("string")).mapInPandas(run, f"{key} string, answer string, error string")


# Answers as rows


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def ip_rows(answers: DataFrame, checked: str) -> DataFrame:
    """Rows of successful answers about addresses; failures give none, so they are asked again."""
    a = answers.select(F.from_json("answer", IP_ANSWER).alias("a")).select("a.*").where("status = 'success'")
    field = F.trim(_text(F.col("as")))
    rest = F.when(field.contains(" "), F.regexp_extract(_text(F.col("as")), "(?s)^[^ ]* (.*)$", 1)).otherwise("")
    name = F.when(_text(F.col("asname")) != "", F.col("asname")).otherwise(rest)
    return a.select(
        F.col("query").alias("ip"), F.regexp_extract(field, r"^\S+", 0).alias("asn"), name.alias("as_name"), *[_text(F.col(c)).alias(c) for c in ("isp", "org", "country")],
        _text(F.col("countryCode")).alias("country_code"), _text(F.col("reverse")).alias("reverse_dns"), F.lit(checked).alias("checked_date"), F.lit("").alias("notes"),
    )


WHOIS_ANSWER = "struct<creation_date: array<string>, registrar: array<string>, name_servers: array<string>, org: array<string>, country: array<string>>"
WALLET_ANSWER = (
    "struct<info: struct<chain_stats: struct<tx_count: long, funded_txo_sum: decimal(38,0), spent_txo_sum: decimal(38,0)>, coin_balance: string>,"
    " counters: struct<transactions_count: string>, recent: array<struct<status: struct<confirmed: boolean, block_time: long>>>>"
)
#: Notes of keys that are never asked again, and where wallets are shown.
WHOIS_FAILED, WALLET_REJECTED = "Bad Request -- WHOIS lookup failed: ", "Bad Request (400) -- API rejected this address, likely malformed/OCR error"
EXPLORERS, REPORTS = {"BTC": "https://blockstream.info/address/", "ETH": "https://eth.blockscout.com/address/"}, "https://www.chainabuse.com/address/"


def domain_rows(answers: DataFrame) -> DataFrame:
    """Rows of ``domain_enrichment`` from answers about registrations; of values that disagree the first holds."""
    a = answers.where("answer IS NOT NULL").select("domain", F.from_json("answer", WHOIS_ANSWER).alias("a")).select("domain", "a.*")
    return a.select("domain", first_of(F.col("creation_date")).alias("registered_date"), first_of(F.col("registrar")).alias("registrar"), nameserver_list(F.col("name_servers")).alias("nameservers"), first_of(F.col("org")).alias("registrant_org"), first_of(F.col("country")).alias("registrant_country"), F.lit("").alias("notes"))


def failed_domains(answers: DataFrame, final: tuple[str, ...] = ("PywhoisError", "NoMatch")) -> DataFrame:
    """Rows of domains about which the service can say nothing; other errors give none."""
    said = reduce(lambda a, b: a | b, [F.col("error").startswith(x) for x in final], F.lit(False))
    blank = [F.lit("").alias(c) for c in ("registered_date", "registrar", "nameservers", "registrant_org", "registrant_country")]
    return answers.where(said).select("domain", *blank, F.concat(F.lit(WHOIS_FAILED), F.regexp_replace("error", "^[^:]*: ", "")).alias("notes"))


def domain_ages(facts: DataFrame, today: Column | None = None) -> DataFrame:
    """``(domain, age)``: days since the first date in ``registered_date``; domains in lower case, the last row of each, none without a valid date."""
    day = F.regexp_extract(F.coalesce("registered_date", F.lit("")), r"\d{4}-\d{2}-\d{2}", 0).try_cast("date")
    d = facts.select(F.lower("domain").alias("domain"), F.datediff(F.current_date() if today is None else today, day).alias("age"), F.monotonically_increasing_id().alias("at"))
    return d.where("age IS NOT NULL AND domain <> ''").groupBy("domain").agg(F.max_by("age", "at").alias("age"))


def _wallet_keys(answers: DataFrame) -> DataFrame:
    return answers.withColumns({"chain": F.substring_index("wallet", ":", 1), "address": F.regexp_replace("wallet", "^[^:]*:", "")})


def wallet_rows(answers: DataFrame, checked: str) -> DataFrame:
    """Rows of ``wallet_enrichment`` from ``(wallet, answer, error)``, where ``wallet`` is ``chain:address``.

    The first day of a Bitcoin address is only known if all its transactions are on the first page; else it is an upper bound.
    A rejected address (400) has a row that says so; other errors give none.
    """
    a = _wallet_keys(answers.where("answer IS NOT NULL OR error LIKE 'HTTPError: HTTP Error 400%'")).withColumn("a", F.from_json("answer", WALLET_ANSWER))
    c, none, zero = F.col, F.lit(""), F.lit(0).cast("decimal(38,0)")
    is_btc, rejected = c("chain") == "BTC", c("answer").isNull()
    n = F.when(is_btc, F.coalesce("a.info.chain_stats.tx_count", F.lit(0))).otherwise(F.coalesce(c("a.counters.transactions_count").try_cast("long"), F.lit(0)))
    funded, spent = (F.coalesce(f"a.info.chain_stats.{x}", zero) for x in ("funded_txo_sum", "spent_txo_sum"))
    wei = F.coalesce(c("a.info.coin_balance").try_cast("decimal(38,0)"), zero)
    half = F.lit(5 * 10**11).cast("decimal(38,0)")
    times = F.transform(F.filter(F.coalesce("a.recent", F.array()), lambda t: t["status"]["confirmed"]), lambda t: t["status"]["block_time"])
    day = lambda x: F.substring(iso_time(x), 1, 10)
    seen = is_btc & (n > 0) & (F.size(times) > 0)
    first = F.concat(F.when(n > 25, "<= ").otherwise(""), day(F.array_min(times)))
    shown = lambda x: F.when(rejected, none).otherwise(x)
    page = F.concat(F.when(is_btc, EXPLORERS["BTC"]).otherwise(EXPLORERS["ETH"]), "address")
    return a.select(
        "address", "chain", shown(n.cast("string")).alias("tx_count"), shown(F.when(~is_btc, none).when(funded > 0, coins(funded, 8, "BTC")).otherwise("0")).alias("total_received"),
        shown(F.when(is_btc & (funded > 0), coins(funded - spent, 8, "BTC")).when(~is_btc & (wei > 0), coins(wei + half, 6, "ETH", drop=12)).otherwise("0")).alias("balance"),
        F.when(seen, first).otherwise("").alias("first_seen"), F.when(seen, day(F.array_max(times))).otherwise("").alias("last_seen"), F.lit(checked).alias("checked_date"),
        page.alias("explorer_url"), F.concat(F.lit(REPORTS), "address").alias("chainabuse_url"), F.when(rejected, WALLET_REJECTED).otherwise("").alias("notes"),
    )


def wallet_transactions(answers: DataFrame) -> DataFrame:
    """Rows of ``wallet_transactions`` from the same answers."""
    t = _wallet_keys(answers.where("answer IS NOT NULL")).select("chain", "address", F.explode(F.from_json(F.get_json_object("answer", "$.transactions"), "array<string>")).alias("payload"))
    return btc_rows(t.where("chain = 'BTC'")).unionByName(eth_rows(t.where("chain <> 'BTC'")))


def nameserver_list(names: Column) -> Column:
    """An array of name servers in lower case, without trailing dots, sorted, each once, as text."""
    tidy = F.transform(F.filter(names, lambda x: x.isNotNull() & (x != "")), lambda x: F.rtrim(F.lower(x), F.lit(".")))
    return _text(F.array_join(F.array_sort(F.array_distinct(tidy)), "; "))


def first_of(values: Column) -> Column:
    return _text(F.try_element_at(values, F.lit(1)))


def btc_rows(transactions: DataFrame) -> DataFrame:
    """Transactions as their address sees them, from ``(address, payload)``; the other side's addresses follow the net flow."""
    t = transactions.select("address", F.from_json("payload", BTC_TRANSACTION).alias("t"))
    zero = F.lit(0).cast("decimal(38,0)")
    ins = F.coalesce(F.transform("t.vin", lambda v: v["prevout"]), F.array())
    outs = F.coalesce(F.col("t.vout"), F.array())
    mine = lambda side: F.aggregate(F.filter(side, lambda v: v["scriptpubkey_address"] == F.col("address")), zero, lambda a, v: (a + F.coalesce(v["value"], zero)).cast("decimal(38,0)"))
    others = lambda side: F.array_sort(F.array_distinct(F.filter(F.transform(side, lambda v: v["scriptpubkey_address"]), lambda x: x.isNotNull() & (x != "") & (x != F.col("address")))))
    t = t.withColumn("ins", ins).withColumn("outs", outs)
    t = t.withColumn("net", mine(F.col("outs")) - mine(F.col("ins"))).withColumn("confirmed", F.coalesce("t.status.confirmed", F.lit(False)))
    none = F.array().cast("array<string>")
    return t.select(
        "address", F.lit("BTC").alias("chain"), _text(F.col("t.txid")).alias("txid"), F.when(F.col("confirmed"), iso_time(F.col("t.status.block_time"))).otherwise("").alias("timestamp"),
        F.when(F.col("confirmed"), _text(F.col("t.status.block_height").cast("string"))).otherwise("").alias("block_height"),
        F.when(F.col("net") > 0, "in").when(F.col("net") < 0, "out").otherwise("self").alias("direction"), coins(F.abs("net"), 8, "BTC").alias("amount"),
        F.array_join(F.when(F.col("net") > 0, others(F.col("ins"))).when(F.col("net") < 0, others(F.col("outs"))).otherwise(none), "; ").alias("counterparty_addresses"),
        "confirmed", F.concat(F.lit("https://blockstream.info/tx/"), _text(F.col("t.txid"))).alias("tx_explorer_url"),
    )


def coins(base_units: Column, digits: int, name: str, drop: int = 0) -> Column:
    """A count of base units, 38 digits at most, as coins with so many decimals, exactly; the last ``drop`` digits are cut off."""
    text = base_units.cast("decimal(38,0)").cast("string")
    text = F.lpad(text, F.greatest(F.length(text), F.lit(digits + drop + 1)), F.lit("0"))
    size = F.length(text)
    return F.concat(F.substr(text, F.lit(1), size - (digits + drop)), F.lit("."), F.substr(text, size - (digits + drop - 1), F.lit(digits)), F.lit(" " + name))


def eth_rows(transactions: DataFrame) -> DataFrame:
    """As :func:`btc_rows` for accounts; a payment to oneself is ``out``.  Amounts have six digits, rounded half up from whole wei."""
    t = transactions.select("address", F.from_json("payload", ETH_TRANSACTION).alias("t"))
    me, sender, to = F.lower("address"), F.lower(_text(F.col("t.from.hash"))), F.lower(_text(F.col("t.to.hash")))
    is_out, is_in = sender == me, (to == me) & (sender != me)
    wei = F.coalesce(F.col("t.value").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    half = F.lit(5 * 10**11).cast("decimal(38,0)")  # of the last digit shown
    return t.select(
        "address", F.lit("ETH").alias("chain"), _text(F.col("t.hash")).alias("txid"), _text(F.col("t.timestamp")).alias("timestamp"),
        _text(F.coalesce("t.block_number", "t.block").cast("string")).alias("block_height"), F.when(is_in, "in").when(is_out, "out").otherwise("self").alias("direction"),
        coins(wei + half, 6, "ETH", drop=12).alias("amount"), F.when(is_in, sender).when(is_out, to).otherwise("").alias("counterparty_addresses"),
        (F.coalesce("t.status", F.lit("")) == "ok").alias("confirmed"), F.concat(F.lit("https://eth.blockscout.com/tx/"), _text(F.col("t.hash"))).alias("tx_explorer_url"),
    )


def activity(transactions: DataFrame) -> DataFrame:
    """Count, and the first and last confirmed day, of each address."""
    day = F.when(F.col("confirmed") & (F.col("timestamp") != ""), F.substring("timestamp", 1, 10))
    return transactions.groupBy("address", "chain").agg(F.count(F.lit(1)).alias("tx_count"), _text(F.min(day)).alias("first_seen"), _text(F.max(day)).alias("last_seen"))


# Upserts


def _filled(new: str, old: str, c: str) -> Column:
    return F.coalesce(F.when(F.col(f"{new}.{c}") != "", F.col(f"{new}.{c}")), F.col(f"{old}.{c}"), F.lit("")).alias(c)


def fill_in(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, where what is not blank in ``new`` replaces the value in ``old``; text columns, one row per key."""
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *[_filled("n", "o", c) for c in old.columns if c != key])


def replace_rows(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("notes",)) -> DataFrame:
    """``new``, and the rows of ``old`` whose key it lacks; columns of ``keep`` stay as ``old`` has them, where it has them."""
    hand = [c for c in keep if c in old.columns]
    kept = new.alias("n").join(old.select(key, *hand).alias("o"), key, "left").select(key, *[_filled("o", "n", c) if c in hand else F.col(f"n.{c}") for c in new.columns if c != key])
    return kept.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def keep_candidates(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still a candidate."""
    return rows.join(found.select(key), key, "left_semi")


def replace_transactions(old: DataFrame, new: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transactions of the checked ``wallets(address, tx_count)`` with any activity are replaced; others stay. Each (address, txid) once."""
    active = wallets.where(C.score(F.col("tx_count").cast("string")) > 0).select("address").distinct()
    return old.join(active, "address", "left_anti").unionByName(new.join(active, "address", "left_semi")).dropDuplicates(["address", "txid"])


def status_row(answers: DataFrame, key: str, permanent: tuple[str, ...] = ("HTTPError: HTTP Error 400",)) -> DataFrame:
    """Keys whose error is final, as rows whose ``notes`` say so; other errors give none and are asked again."""
    final = reduce(lambda a, b: a | b, [F.col("error").startswith(p) for p in permanent], F.lit(False))
    return answers.where(final).select(key, F.concat(F.lit("lookup failed: "), F.col("error")).alias("notes"))


# Relations over the dimensions


def wallet_report(m: DataFrame, wallets: DataFrame) -> DataFrame:
    """Wallets of ``indicators`` with their facts; ``wallets`` has one row per address, whatever the chain."""
    seen = m.select("seq", "from_domain", F.posexplode("indicators").alias("at", "_i")).where("_i.kind IN ('btc', 'eth')").groupBy(F.upper("_i.kind").alias("chain"), F.col("_i.value").alias("address"))
    g = seen.agg(F.count(F.lit(1)).alias("times_seen"), F.countDistinct(F.when(F.col("from_domain") != "", F.col("from_domain"))).alias("distinct_domains"), F.min("seq").alias("first_seq"), F.min(F.struct("seq", "at")).alias("first"))
    return wallet_facts(g, wallets)


def wallet_facts(seen: DataFrame, wallets: DataFrame) -> DataFrame:
    """Wallets ``(address, ...)`` with their facts and whether they were ever used."""
    facts = wallets.withColumnsRenamed({"first_seen": "first_active", "last_seen": "last_active"}) if "first_seen" in wallets.columns else wallets
    d = seen.join(facts, "address", "left").withColumn("tx_count", C.score(F.coalesce(F.col("tx_count").cast("string"), F.lit(""))))
    return d.withColumn("active", F.col("tx_count") > 0)


def ip_report(m: DataFrame, ips: DataFrame) -> DataFrame:
    """Addresses of origin with their facts and whether they are artifacts of the mail exchange."""
    seen = m.select("seq", "from_domain", F.inline("indicators")).where("kind = 'ip'").groupBy(F.col("value").alias("ip"))
    g = seen.agg(F.count(F.lit(1)).alias("times_seen"), F.countDistinct(F.when(F.col("from_domain") != "", F.col("from_domain"))).alias("distinct_domains"), F.min("seq").alias("first_seq"))
    return ip_facts(g, ips)


def ip_facts(seen: DataFrame, ips: DataFrame) -> DataFrame:
    """Addresses ``(ip, times_seen, distinct_domains, first_seq)`` with their facts."""
    blank = [_text(F.col(c)).alias(c) for c in ("asn", "as_name", "isp", "country")]
    return seen.join(ips, "ip", "left").select("ip", "times_seen", "distinct_domains", *blank, C.is_artifact(F.col("ip"), F.col("isp"), F.col("asn")).alias("artifact"), "first_seq")


def transactions_report(transactions: DataFrame) -> DataFrame:
    """By address, then time, both as text."""
    return transactions.select(*TRANSACTION_COLUMNS).orderBy("address", "timestamp", "txid")
