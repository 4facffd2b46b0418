"""The message table: its 39 columns, typed or as text, and what the report relations read.

A list column is an array in the typed form and text joined by ``"; "`` in the
text form; both ways an item that holds a semicolon is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import columns as C

#: Columns of the message table, in order (fixed values).
COLUMNS = (
    "id source category scam_score scam_signals date date_iso subject from_name from_addr from_domain return_path reply_to_addr list_unsubscribe dkim spf dmarc originating_ips url_count url_domains"
    " phone_numbers btc_addresses eth_addresses contact_emails_in_body contacts_functional contacts_filler phones_functional phones_filler first_url impersonated_brands body_template_fingerprint"
    " link_mismatches url_flags remote_image_domains image_count image_hashes image_phashes image_filenames image_ocr_chars"
).split()
LISTS = (
    "scam_signals originating_ips url_domains phone_numbers btc_addresses eth_addresses contact_emails_in_body contacts_functional contacts_filler phones_functional phones_filler"
    " impersonated_brands link_mismatches url_flags remote_image_domains image_hashes image_phashes image_filenames"
).split()
NUMBERS = "scam_score url_count image_count image_ocr_chars".split()
#: Columns of the table of links, in order (fixed values).
URL_COLUMNS = "id url domain".split()
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_ENDS = "uary ruary ch il e y ust tember ober ember".split()


def from_signals(s: DataFrame) -> DataFrame:
    """The typed message table from ``sources.mail.signals``, with ``path``, ``position`` and ``urls`` beside it."""
    c = F.col
    own = F.transform("images", lambda x: x["hash"])
    filled = lambda f: F.filter(F.transform("images", lambda x: x[f]), lambda x: x != "")
    found = {
        "url_count": F.size("urls"),
        "url_domains": F.array_sort(F.array_distinct(F.filter(F.transform("urls", C.url_domain), lambda x: x != ""))),
        "first_url": F.coalesce(F.get("urls", F.lit(0)), F.lit("")),
        "phone_numbers": c("phones"),
        "contact_emails_in_body": c("contact_emails"),
        "url_flags": c("flags"),
        "image_count": F.size("images"),
        "image_hashes": own,
        "image_phashes": filled("phash"),
        "image_filenames": filled("name"),
    }
    d = s.withColumns(found)
    d = d.withColumns({x: C.split_list(F.array_join(x, "; ")) for x in LISTS} | {x: c(x).cast("int") for x in NUMBERS})
    return d.select("path", "position", "urls", *COLUMNS)


def from_text(rows: DataFrame) -> DataFrame:
    """The typed table from one of text columns; other columns, such as ``seq``, stay."""
    typed = {x: C.split_list(F.coalesce(x, F.lit(""))) for x in LISTS} | {x: C.score(F.col(x)) for x in NUMBERS}
    return rows.withColumns(typed | {"list_unsubscribe": F.coalesce(F.col("list_unsubscribe") == "True", F.lit(False))})


def month(date_iso: Column, date: Column) -> Column:
    """``YYYY-MM`` of the day, or of the raw date of a mail where that is blank; empty if neither is known.

    Raw dates are read as mail readers do: ``[weekday,] day month year time
    [zone]``, month and day in either order, or ``day-month-year time zone``; of
    two digits, years from 69 are of the last century.  A day or time that
    doesn't exist gives none.
    """
    day = F.trim(F.coalesce(date_iso, F.lit("")))
    raw = F.coalesce(date, F.lit(""))
    names = "(" + "|".join(_MONTHS) + ")(?:" + "|".join(x for x in _MONTH_ENDS) + ")?"
    time = r"(?:[01]?\d|2[0-3])[:.][0-5]?\d(?:[:.][0-5]?\d)?"
    weekday = r"(?i)^\s*(?:[a-z]+,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
    forms = [  # pattern, and the groups of day, month and year
        (rf"{weekday}(\d{{1,2}})\s+{names}\s+(\d{{4}}|\d\d),?\s+{time}(?:\s|[+-]|$)", (1, 2, 3)),
        (rf"{weekday}{names}\s+(\d{{1,2}}),?\s+(\d{{4}}|\d\d),?\s+{time}(?:\s|[+-]|$)", (2, 1, 3)),
        (rf"{weekday}(\d{{1,2}})-{names}-(\d{{4}}|\d\d)\s+{time}\s+\S+\s*$", (1, 2, 3)),
    ]
    found = F.lit("")
    for pattern, (d, m, y) in reversed(forms):
        part = lambda i, p=pattern: F.regexp_extract(raw, p, i)
        year = F.when(F.length(part(y)) == 4, part(y)).when(part(y) > "68", F.concat(F.lit("19"), part(y))).otherwise(F.concat(F.lit("20"), part(y)))
        number = F.lpad(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(m))).cast("string"), 2, "0")
        known = F.concat_ws("-", year, number, F.lpad(part(d), 2, "0")).try_cast("date").isNotNull()
        found = F.when(part(m) == "", found).when(known, F.concat(year, F.lit("-"), number)).otherwise("")
    return F.when(F.length(day) >= 7, F.substring(day, 1, 7)).otherwise(found)


def relation(m: DataFrame) -> DataFrame:
    """The typed table, with ``seq``, as the report reads it: with ``month, origin_ip, brands, indicators, fp``.

    ``indicators`` are (kind, value, functional) in the order in which they are
    counted: phones, addresses, wallets, images, and the address of origin.
    """

    def found(kind: str, values: Column, functional: Column | None = None) -> Column:
        low = None if functional is None else F.transform(functional, lambda x: F.lower(x))
        is_functional = lambda v: F.lit(False) if low is None else F.array_contains(low, F.lower(v))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), is_functional(v).alias("functional")))

    c = F.col
    d = m.withColumns({"origin_ip": C.origin_ip(c("originating_ips")), "month": month(c("date_iso"), c("date")), "brands": c("impersonated_brands"), "fp": F.coalesce(F.conv("body_template_fingerprint", 16, -10).cast("long"), F.lit(0))})
    origin = F.filter(F.array("origin_ip"), lambda x: x != "")
    return d.withColumn(
        "indicators",
        F.concat(
            found("phone", c("phone_numbers"), c("phones_functional")), found("email", c("contact_emails_in_body"), c("contacts_functional")),
            found("btc", c("btc_addresses")), found("eth", c("eth_addresses")), found("image", c("image_hashes")), found("ip", origin),
        ),
    )


def links(m: DataFrame) -> DataFrame:
    """``(id, seq, position, url, domain)``: one row per link of ``(id, seq, urls)``."""
    return m.select("id", "seq", F.posexplode("urls").alias("position", "url")).withColumn("domain", C.url_domain(F.col("url")))
