"""Scalar functions as native column expressions; all stay inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import rules

#: What is left, in lower case, of letters that match i, k or s without regard to case: dotted and dotless i, long s.
_FOLDED = ("\u0307", "\u0131", "\u017f")


def root(domain: Column) -> Column:
    """The last two labels."""
    return F.substring_index(domain, ".", -2)


def url_domain(url: Column) -> Column:
    """Lower-case authority of a URL, with user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def urls(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit("(?i)" + rules.URL), F.lit(0)))


def emails(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(rules.EMAIL), F.lit(0))))


def contact_emails(body: Column, from_addr: Column, self_addresses: list[str] = ()) -> Column:
    """Addresses other than the sender's, one's own, and those of known services and their subdomains."""
    own = [x.lower() for x in self_addresses]
    service = "(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in rules.KNOWN_SERVICE) + ")$"
    return F.filter(emails(body), lambda e: (F.lower(e) != F.lower(from_addr)) & ~F.lower(e).isin(*own, "") & ~F.substring_index(F.lower(e), "@", -1).rlike(service))


def wallets(body: Column) -> tuple[Column, Column]:
    return F.array_distinct(F.regexp_extract_all(body, F.lit("(?U)" + rules.BTC), F.lit(1))), F.array_distinct(F.regexp_extract_all(body, F.lit("(?U)" + rules.ETH), F.lit(0)))


def auth_result(header: Column, mechanism: str) -> Column:
    return F.lower(F.regexp_extract(header, rf"(?iU){mechanism}=(\w+)", 1))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none: octets over 255 and leading zeros are not valid."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    p = F.split(ip, "\\.")
    value = reduce(lambda a, i: a * 256 + F.get(p, F.lit(i)).try_cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(ip.rlike(f"^{octet}(\\.{octet}){{3}}$"), value)


def is_global_ip(ip: Column) -> Column:
    def number(text: str) -> int:
        return reduce(lambda a, x: a * 256 + int(x), text.split("."), 0)

    n = ip_number(ip)
    inside = reduce(lambda a, b: a | b, [n.between(number(a), number(a) + (1 << (32 - bits)) - 1) for a, bits in rules.NOT_GLOBAL])
    return F.coalesce(~inside | ip.isin(*rules.STILL_GLOBAL), F.lit(False))


def received_ips(headers: Column) -> Column:
    """Global addresses in brackets or parentheses, in order, each once."""
    found = F.regexp_extract_all(headers, F.lit(r"[\[(](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})[\])]"), F.lit(1))
    return F.array_distinct(F.filter(found, is_global_ip))


def origin_ip(ips: Column) -> Column:
    """The last global address, or empty."""
    return F.coalesce(F.try_element_at(F.filter(ips, is_global_ip), F.lit(-1)), F.lit(""))


def url_flags(urls: Column) -> Column:
    def flags(u: Column) -> Column:
        d = url_domain(u)
        return F.array_compact(F.array(F.when(d.contains("xn--"), F.concat(F.lit("punycode:"), d)), F.when(d.isin(*rules.SHORTENERS) | root(d).isin(*rules.SHORTENERS), F.concat(F.lit("shortener:"), d))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(urls, flags))))


def brands(text: Column) -> Column:
    """Brands whose phrases are in the text, sorted.

    A phrase is looked for where its longest word is in the lower-cased text, or
    a letter that stands for one of a to z without regard to case only.
    """
    longest = lambda phrase: max(re.findall("[a-z0-9]+", phrase.lower()), key=len)

    def found(low: Column) -> Column:
        one = []
        for b in sorted(rules.BRANDS):
            words = [*sorted({longest(p) for p in rules.BRANDS[b][0]}), *_FOLDED]
            maybe = reduce(lambda x, y: x | y, [low.contains(w) for w in words])
            one.append(F.when(maybe & text.rlike("(?iU)" + rules.phrase_pattern(rules.BRANDS[b][0])), F.lit(b)))
        return F.array_compact(F.array(*one))

    return F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))  # bound, so that it is made once


def display_brands(name: Column) -> Column:
    """Brands that a sender's name claims, sorted: by their own name, the shortest by their phrases, with no words in between."""
    phrases = lambda b: rules.BRANDS[b][0] if len(b) <= 3 else [b]
    return F.array_compact(F.array(*[F.when(name.rlike("(?iU)" + rules.phrase_pattern(phrases(b), 0)), F.lit(b)) for b in sorted(rules.BRANDS)]))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def message_id(header: Column, date: Column, sender: Column, subject: Column) -> Column:
    key = stripped(F.coalesce(header, F.lit("")))
    rest = F.concat_ws("\0", *[F.coalesce(x, F.lit("")) for x in (date, sender, subject)])
    return F.substring(F.sha1(F.when(key != "", key).otherwise(rest).cast("binary")), 1, 10)


def sender_key(domain: Column, address: Column) -> Column:
    """Free-mail senders stand for themselves, others for their domain."""
    return F.when(domain.isin(*rules.FREEMAIL) & (address != ""), F.lower(F.trim(address))).otherwise(domain)


def score(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def split_list(text: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def is_artifact(ip: Column, isp: Column, asn: Column) -> Column:
    return ip.startswith("15.") & (F.coalesce(isp, F.lit("")) == "HP Inc.") & (F.trim(F.coalesce(asn, F.lit(""))) == "")


def ns_roots(nameservers: Column) -> Column:
    labels = F.filter(F.transform(split_list(F.lower(nameservers)), root), lambda x: x.contains("."))
    return F.array_sort(F.array_distinct(labels))


def defang_domain(x: Column) -> Column:
    return F.replace(x, F.lit("."), F.lit("[.]"))


def defang_ip(x: Column) -> Column:
    return F.replace(defang_domain(x), F.lit(":"), F.lit("[:]"))


def defang_email(x: Column) -> Column:
    at = F.regexp_extract(x, "(?s)^(.*)@([^@]*)$", 2)
    return F.when(x.contains("@"), F.concat(F.regexp_extract(x, "(?s)^(.*)@([^@]*)$", 1), F.lit("[@]"), defang_domain(at))).otherwise(x)


def defang_url(x: Column) -> Column:
    y = F.replace(F.replace(x, F.lit("https://"), F.lit("hxxps[://]")), F.lit("http://"), F.lit("hxxp[://]"))
    at = F.instr(y, "[://]")
    return F.when(at > 0, F.concat(F.substr(y, F.lit(1), at + 4), defang_domain(F.substr(y, at + 5)))).otherwise(defang_domain(y))


def defang_target(kind: Column, target: Column) -> Column:
    return F.when(kind == "domain", defang_domain(target)).when(kind == "ip", defang_ip(target)).when(kind == "email", defang_email(target)).when(kind == "url", defang_url(target)).otherwise(target)


def template_text(body: Column) -> Column:
    """The body without links, addresses, phone numbers and wallets, in lower case."""
    for pattern in ("(?i)" + rules.URL, rules.EMAIL, rules.PHONE, "(?U)" + rules.BTC, "(?U)" + rules.ETH):
        body = F.regexp_replace(body, pattern, " ")
    return F.lower(body)
