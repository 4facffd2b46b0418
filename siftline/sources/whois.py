"""Registrations of domains over port 43, for :func:`siftline.sources.explorers.domain_client`.

The root server names the registry of a top-level domain, the registry often the
registrar; each is asked in turn, none twice.  What the registry says comes first.

Defined results: a domain that the registry doesn't know raises :class:`NoMatch`,
which is final; a time-out, a refusal or an answer of more than ``MOST`` bytes
by the root or the registry is an ``OSError``, so the domain is asked again.  A
registrar that can't be asked leaves the record of the registry.  A field that
no one gives is empty.
"""

from __future__ import annotations

import re
import socket
import time
from collections.abc import Callable
from datetime import datetime

#: The root of all registries, the port, how many servers are asked about a domain at most.
ROOT, PORT, HOPS = "whois.iana.org", 43, 4
MOST = 1 << 20
#: Names under which servers give a field, in lower case.
FIELDS = {
    "creation_date": ("creation date", "created", "created on", "registered", "registered on", "registration time", "domain registration date"),
    "registrar": ("registrar", "registrar name", "sponsoring registrar"),
    "name_servers": ("name server", "name servers", "nserver", "nameserver"),
    "org": ("registrant organization", "registrant organisation", "org"),
    "country": ("registrant country", "registrant country/economy", "country"),
}
NEXT = ("refer", "whois", "registrar whois server", "whois server")
UNKNOWN = re.compile(r"(?im)^\W*(no match\b|not found\b|no data found|no entries found|domain not found|no object found|status:\s*(free|available)\b)")
REFUSED = re.compile(r"(?i)\b(quota|limit|rate)\b[^\n]*\bexceeded\b|too many (requests|queries)")
DATES = ("%Y-%m-%d", "%d-%b-%Y", "%Y.%m.%d", "%d.%m.%Y", "%Y/%m/%d", "%Y%m%d")
_HOST = re.compile(r"[a-z0-9]([a-z0-9.-]*[a-z0-9])?(:\d{1,5})?")


class NoMatch(LookupError):
    """No registry knows the domain."""


def ask(server: str, query: str, timeout: float = 10) -> str:
    """The answer of ``server``, a host or ``host:port``; ``timeout`` holds for the whole of it."""
    host, _, port = server.partition(":")
    until, got = time.monotonic() + timeout, bytearray()
    with socket.create_connection((host, int(port or PORT)), timeout) as s:
        s.sendall(query.encode("ascii") + b"\r\n")
        while True:
            left = until - time.monotonic()
            if left <= 0:
                raise TimeoutError(f"{server}: timed out")
            s.settimeout(left)
            part = s.recv(1 << 14)
            if not part:
                return got.decode("utf-8", "replace")
            got += part
            if len(got) > MOST:
                raise OSError(f"{server}: an answer of more than {MOST} bytes")


def pairs(text: str) -> list[tuple[str, str]]:
    """``(name, value)`` of the lines ``name: value``, names in lower case; lines without a name belong to the name before, if that stood alone."""
    out, alone = [], ""
    for line in text.splitlines():
        name, colon, value = line.strip().partition(":")
        if line.lstrip()[:1] in ("%", "#", ">"):
            continue
        if colon and not value.strip() and name:
            alone = name.lower().strip()
        elif colon and re.fullmatch(r"[A-Za-z][A-Za-z /._-]*", name):
            out.append((name.lower().strip(" ."), value.strip()))
            alone = ""
        elif alone and line.strip():
            out.append((alone, line.strip()))
        else:
            alone = ""
    return out


def day(text: str) -> datetime | str:
    """A date, or the text where it is in no known form."""
    for form in DATES:
        try:
            return datetime.strptime(re.split(r"[T ]", text)[0], form)
        except ValueError:
            continue
    return text


def parsed(text: str) -> dict[str, list]:
    """The fields of one answer."""
    given = pairs(text)
    found = {field: [v for n, v in given if n in names and v] for field, names in FIELDS.items()}
    found["creation_date"] = [day(x) for x in found["creation_date"]]
    found["name_servers"] = [x.split()[0] for x in found["name_servers"]]  # addresses may follow
    return found


def following(text: str) -> str | None:
    """The server that an answer refers to."""
    for name, value in pairs(text):
        host = value.lower().removeprefix("whois://").removeprefix("rwhois://").rstrip("/.")
        if name in NEXT and _HOST.fullmatch(host):
            return host
    return None


def record(domain: str, ask: Callable[[str, str], str] = ask, root: str = ROOT) -> dict[str, list]:
    """What is known of a domain, each field a list in the order of the servers."""
    name = domain.strip().strip(".").lower().encode("idna").decode()
    if not re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+", name):
        raise ValueError(f"not a domain: {domain!r}")
    server, asked = following(ask(root, name.rpartition(".")[2])), {root}
    if server is None:
        raise NoMatch(f"No match: no registry for {name}")
    out: dict[str, list] = {f: [] for f in FIELDS}
    while server and server not in asked and len(asked) < HOPS:
        asked.add(server)
        by_registry = len(asked) == 2
        try:
            text = ask(server, name)
            if REFUSED.search(text) and not parsed(text)["registrar"]:
                raise ConnectionRefusedError(f"{server}: {text.strip()[:80]}")
        except OSError:
            if by_registry:
                raise
            break
        if UNKNOWN.search(text):
            if by_registry:
                raise NoMatch(f"No match: {name}")
            break
        for field, values in parsed(text).items():
            out[field] += [v for v in values if v not in out[field]]
        server = following(text)
    return out
