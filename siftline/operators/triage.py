"""The weighted rules as one native projection, with reasons in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import rules
from siftline.functions import columns as C


def _literal(text: Column) -> Column:
    """Text in quotes, with backslashes and whatever can't be printed escaped."""

    def shown(x: Column) -> Column:
        code = F.ascii(x)
        number = lambda width: F.lpad(F.lower(F.hex(code)), width, "0")
        escaped = F.when(code < 256, F.concat(F.lit("\\x"), number(2))).when(code < 65536, F.concat(F.lit("\\u"), number(4))).otherwise(F.concat(F.lit("\\U"), number(8)))
        named = F.when(x == "\\", "\\\\").when(x == "\n", "\\n").when(x == "\r", "\\r").when(x == "\t", "\\t")
        return named.when(x.rlike(r"[\p{C}\p{Z}]") & (x != " "), escaped).otherwise(x)

    plain = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), shown), "")
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def triage(signals: DataFrame) -> DataFrame:
    """Adds ``category, scam_score, scam_signals``.

    Columns read: ``from_domain, reply_domain, dmarc, spf, dkim`` (empty if none), ``subject, body, display_name``,
    ``age, root_age`` (days, may be null), ``n_mismatch, n_wallets`` (numbers), ``flags`` (array), ``list_unsubscribe`` (boolean).
    """
    c = F.col
    root, reply_root = C.root(c("from_domain")), C.root(c("reply_domain"))
    text = F.concat(c("subject"), F.lit("\n"), c("body"))
    urgent = F.substring(F.regexp_extract(text, "(?iU)" + rules.phrase_pattern(rules.URGENT), 0), 1, 40)
    quoted = _literal(urgent)
    official = F.create_map(*[x for b, (_, d) in rules.BRANDS.items() for x in (F.lit(b), F.array(*map(F.lit, d)))])
    false_brand = F.get(F.filter(C.display_brands(c("display_name")), lambda b: ~F.array_contains(official[b], root) & ~F.array_contains(official[b], c("from_domain"))), F.lit(0))
    root_age = F.when(c("from_domain") == root, F.coalesce(c("root_age"), c("age"))).otherwise(c("root_age"))
    age = F.when(c("age") != 0, c("age")).otherwise(root_age)  # an age of 0 gives way to the root's, known or not
    diverted = (reply_root != "") & (root != "") & (reply_root != root)
    free = reply_root.isin(*rules.FREEMAIL)
    puny = F.exists(c("flags"), lambda x: x.startswith("punycode:"))

    def rule(when, points, reason):
        return F.when(when, F.struct(F.lit(points).cast("int").alias("points"), reason.alias("reason")))

    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # Points and the texts of the reasons.
    fired = F.array_compact(
        F.array(
            rule(urgent != "", 3, say("urgent keyword: ", quoted)),
            rule((root != "") & false_brand.isNotNull(), 3, say("display name claims ", false_brand, ", sent from ", c("from_domain"))),
            rule(diverted & free, 2, say("reply-to diverted to freemail (", c("reply_domain"), ")")),
            rule(diverted & ~free, 1, say("reply-to domain (", c("reply_domain"), ") != from domain")),
            rule(c("dmarc") == "fail", 2, F.lit("dmarc=fail")),
            rule(c("spf").isin("fail", "softfail"), 1, say("spf=", c("spf"))),
            rule(c("dkim") == "fail", 1, F.lit("dkim=fail")),
            rule(age < 90, 3, say("sender domain registered ", age.cast("string"), " days ago")),
            rule((age >= 90) & (age < 365), 1, say("sender domain registered ", age.cast("string"), " days ago")),
            rule(c("from_domain").rlike("\\.edu$|\\.edu\\.|\\.ac\\."), 2, F.lit("unsolicited mail from academic domain (often compromised)")),
            rule(c("n_mismatch") > 0, 2, say(c("n_mismatch").cast("string"), " link(s) whose visible text hides the real destination")),
            rule(c("n_wallets") > 0, 1, F.lit("crypto wallet address in body")),
            rule(puny, 2, F.lit("punycode (IDN look-alike) domain in URL")),
            rule(~puny & (F.size("flags") > 0), 1, F.lit("URL shortener hides destination")),
        )
    )
    legit = c("from_domain").isin(*rules.KNOWN_LEGIT) | root.isin(*rules.KNOWN_LEGIT)
    d = signals.withColumn("scam_signals", F.when(legit, F.array(F.lit("known legit domain"))).otherwise(F.transform(fired, lambda x: x["reason"])))
    d = d.withColumn("scam_score", F.when(legit, 0).otherwise(F.aggregate(fired, F.lit(0), lambda a, x: a + x["points"])))
    return d.withColumn("category", F.when(legit, "bulk_marketing").when(c("scam_score") >= 3, "likely_scam").when((c("scam_score") == 0) & c("list_unsubscribe"), "bulk_marketing").otherwise("review"))
