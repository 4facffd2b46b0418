"""Fixed values of the mail rules: word lists, domains, patterns and field names."""

from __future__ import annotations

import re

# Fixed values.
KNOWN_SERVICE = "fastly.com podio.com calendly.com google.com microsoft.com apple.com amazon.com paypal.com shopify.com shopifyemail.com parsec.app ibm.com zoom.us stripe.com mailchimp.com sendgrid.net twitter.com x.com facebook.com linkedin.com".split()
KNOWN_LEGIT = "substack.com calendly.com usajobs.gov google.com accounts.google.com mail.google.com linkedin.com fastly.com podio.com".split()
FREEMAIL = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com proton.me protonmail.com icloud.com me.com mail.com gmx.com gmx.net yandex.com yandex.ru zoho.com mail.ru".split()
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl is.gd cutt.ly rb.gy rebrand.ly ow.ly buff.ly shorturl.at t.ly s.id tiny.cc lnkd.in qrco.de".split()
URGENT = [
    "act now", "urgent", "verify your account", "suspended", "final notice", "wire transfer", "gift card", "bitcoin", "crypto wallet", "inheritance", "next of kin", "congratulations you have won", "claim your prize",
    "social security number", "confirm your identity", "unusual activity", "account has been locked", "account locked", "response required", "overdue", "irreversible", "last warning", "action needed", "critical alert",
    "will be erased", "will be wiped", "will be deleted", "charged your bank", "call now", "you have won", "you've won", "you are our", "claim your free", "claim your exclusive", "confirmed: you have won", "welcome free spins",
    "free spins", "no deposit needed", "congratulations, ", "3rd winner", "reward is ready", "ready to claim", "storage is full", "deletion will start", "secure your data", "cloud is full", "account has been blocked",
    "will be removed", "payment failed", "attempt 3 of 3", "2nd attempt", "account will be closed", "your account will be closed", "glp-1", "lose weight effortlessly", "lose up to", "doctor reveals", "suspensão", "suspensao",
    "bloqueio", "regularize", "regularizar", "pendência", "pendencia", "protocolo", "notificação oficial", "notificacao oficial", "infração", "infracao", "multa", "alfândega", "alfandega", "devolução", "devolucao",
    "ação necessária", "acao necessaria", "suspensión", "suspension", "urgente", "acción requerida", "accion requerida", "última oportunidad", "ultima oportunidad",
]
#: Brand: key phrases, official domains.
BRANDS = {
    "Aflac": (["aflac"], ["aflac.com"]), "AARP": (["aarp"], ["aarp.org"]), "Medicare": (["medicare"], ["medicare.gov", "cms.gov"]),
    "Social Security Administration": (["social security administration", "ssa.gov"], ["ssa.gov"]), "IRS": (["internal revenue service", " irs ", "irs.gov"], ["irs.gov"]),
    "USPS": (["usps", "united states postal service", "u.s. postal service"], ["usps.com", "usps.gov"]), "FedEx": (["fedex"], ["fedex.com"]), "UPS": (["ups.com", "united parcel service"], ["ups.com"]),
    "Amazon": (["amazon.com", "your amazon", "amazon order", "amazon account"], ["amazon.com"]), "Netflix": (["netflix"], ["netflix.com"]), "PayPal": (["paypal"], ["paypal.com"]),
    "Apple": (["apple id", "icloud storage", "your apple account"], ["apple.com", "icloud.com"]), "Microsoft": (["microsoft account", "office 365", "windows defender"], ["microsoft.com", "outlook.com", "live.com"]),
    "Norton": (["norton antivirus", "norton security", "norton renewal"], ["norton.com", "nortonlifelock.com", "gendigital.com"]), "McAfee": (["mcafee"], ["mcafee.com"]), "Geek Squad": (["geek squad"], ["bestbuy.com", "geeksquad.com"]),
    "DocuSign": (["docusign"], ["docusign.com", "docusign.net"]), "Coinbase": (["coinbase"], ["coinbase.com"]), "Bank of America": (["bank of america"], ["bankofamerica.com", "bofa.com"]),
    "Wells Fargo": (["wells fargo"], ["wellsfargo.com"]), "Chase": (["chase bank", "jpmorgan chase"], ["chase.com", "jpmorganchase.com", "jpmchase.com"]),
}
URL = r"""https?://[^\s"'<>)\]]+"""
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d[\d\s\-.()]{7,18}\d)"
PHONE_WORD = r"(call|phone|tel\b|dial|contact|hotline|support)"
BTC = r"\b(bc1[a-z0-9]{25,39}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
ETH = r"\b0x[a-fA-F0-9]{40}\b"
CONTACT_WORD = r"(contact|reply to|email us|write to|book|schedule|questions|support|reach us|for more info|inquiries|call now|call us)"
HIDDEN = r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em|rem|;|\s|$)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)"
DOMAINISH = r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"
SPELLED_EMAIL = r"([a-zA-Z0-9._%+-]+)\s*[(\[]?\s*at\s*[)\]]?\s*([a-zA-Z0-9.-]+)\s*[(\[]?\s*dot\s*[)\]]?\s*([a-zA-Z]{2,})"
VOID_TAGS = "br img hr input meta link area base col embed source track wbr".split()
IMAGE_SUFFIXES = ".png .jpg .jpeg .gif .bmp .webp .tif .tiff".split()
#: IPv4 networks that are not global, as first address, prefix length; and the exceptions inside them.
NOT_GLOBAL = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
STILL_GLOBAL = ["192.0.0.9", "192.0.0.10"]


def phrase_pattern(phrases: list[str], gap: int = 2) -> str:
    """One alternation; the words of a phrase may have up to ``gap`` other words between them, as few as will do."""
    between = r"\W+(?:\w+\W+){0,%d}?" % gap
    parts = [between.join(re.findall("[a-z0-9]+", p.lower())) for p in phrases]
    return r"\b(?:" + "|".join(parts) + r")\b"
