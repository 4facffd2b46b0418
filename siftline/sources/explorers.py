"""Lookup services: wallets, addresses and registrations, each behind a function that the caller can replace.

``get`` is a function from a URL to parsed JSON; :func:`get_json` is one over
the network.  An answer is JSON text, as the projections of
``plans.enrichment`` read it, so nothing here needs Spark.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

#: The services, the size of a page of confirmed transactions, and how many transactions of an address are kept.
BTC = "https://blockstream.info/api/address/"
ETH = "https://eth.blockscout.com/api/v2/addresses/"
IPS = "http://ip-api.com/batch?fields=status,message,country,countryCode,isp,org,as,asname,reverse,query"
BTC_PAGE, MOST_TRANSACTIONS = 25, 1_000
AGENT = "siftline"

Get = Callable[[str], object]


def get_json(url: str, timeout: float = 20, body: object = None) -> object:
    data = None if body is None else json.dumps(body).encode()
    headers = {"User-Agent": AGENT} | ({"Content-Type": "application/json"} if data else {})
    with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers), timeout=timeout) as answer:
        return json.loads(answer.read().decode("utf-8"))


def _first(items: Iterator[dict], key: str, most: int) -> list[dict]:
    """The first items of each key, ``most`` at most."""
    out: dict[object, dict] = {}
    for x in items:
        out.setdefault(x.get(key), x)
    return list(out.values())[:most]


def btc_pages(get: Get, address: str, first: list[dict], most: int, pause: float) -> Iterator[dict]:
    """Transactions, newest first; each page after the first begins behind the last confirmed one."""
    page, seen = first, 0
    while page:
        yield from page
        seen += len(page)
        confirmed = [t for t in page if (t.get("status") or {}).get("confirmed")]
        if len(confirmed) < BTC_PAGE or seen >= most:
            return
        time.sleep(pause)
        page = get(f"{BTC}{address}/txs/chain/{confirmed[-1]['txid']}")


def btc_wallet(get: Get, address: str, most: int = MOST_TRANSACTIONS, pause: float = 0.3) -> str:
    info = get(BTC + address)
    first = get(f"{BTC}{address}/txs") if (info.get("chain_stats") or {}).get("tx_count") else []
    return json.dumps({"info": info, "recent": first, "transactions": _first(btc_pages(get, address, first, most, pause), "txid", most)})


def eth_pages(get: Get, address: str, most: int, pause: float) -> Iterator[dict]:
    url = base = f"{ETH}{address}/transactions"
    seen = 0
    while True:
        page = get(url)
        items = page.get("items") or []
        yield from items
        seen += len(items)
        after = page.get("next_page_params")
        if not after or seen >= most:
            return
        time.sleep(pause)
        url = f"{base}?{urllib.parse.urlencode(after)}"


def eth_wallet(get: Get, address: str, most: int = MOST_TRANSACTIONS, pause: float = 0.3) -> str:
    """An address that the service has never seen (404) has no transactions."""
    try:
        info = get(ETH + address)
    except urllib.error.HTTPError as e:
        if e.code != 404:
            raise
        return json.dumps({"info": {}, "counters": {}, "transactions": []})
    counters = get(f"{ETH}{address}/counters")
    n = int(counters.get("transactions_count") or 0)
    return json.dumps({"info": info, "counters": counters, "transactions": list(eth_pages(get, address, most, pause))[:most] if n else []})


def wallet_client(get: Get = get_json, most: int = MOST_TRANSACTIONS, pause: float = 0.3) -> Callable[[list[str]], list[str]]:
    """A client of keys ``chain:address``."""

    def one(key: str) -> str:
        chain, _, address = key.partition(":")
        return (btc_wallet if chain == "BTC" else eth_wallet)(get, address, most, pause)

    return lambda keys: [one(k) for k in keys]


def ip_client(post: Callable[[str, list[str]], list[dict]] | None = None) -> Callable[[list[str]], list[str | None]]:
    """A client of addresses, asked 100 at a time; answers may come in any order."""
    ask = post or (lambda url, keys: get_json(url, 30, keys))

    def client(keys: list[str]) -> list[str | None]:
        by = {x.get("query"): json.dumps(x) for x in ask(IPS, keys)}
        return [by.get(k) for k in keys]

    return client


def domain_client(whois: Callable[[str], dict]) -> Callable[[list[str]], list[str]]:
    """A client of domains over ``whois``, a function from a domain to a record; each field becomes a list of texts.

    A time of registration is cut to its day.
    """

    def texts(value: object) -> list[str]:
        values = value if isinstance(value, (list, tuple, set)) else [value]
        return [str(x.date()) if hasattr(x, "date") else str(x) for x in values if x is not None]

    return lambda keys: [json.dumps({f: texts((r or {}).get(f)) for f in ("creation_date", "registrar", "name_servers", "org", "country")}) for r in map(whois, keys)]
