"""The steps as commands: ``main(argv, spark)`` runs one on a store, ``python -m siftline.commands --help`` lists them.

Lookups of registrations need a function ``whois`` from a domain to a record,
as ``module:function``; the other services are reached over the network.
"""

from __future__ import annotations

import argparse
import datetime
from importlib import import_module

from pyspark.sql import SparkSession

from siftline.plans.store import Store, publish, self_addresses
from siftline.sources import explorers, tables


#: The function that is asked about a domain unless another is named.
WHOIS = "siftline.sources.whois:record"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__.partition("\n")[0])
    p.add_argument("store", help="folder of the tables")
    p.add_argument("--self-addresses", default="", help="file of one's own addresses, one a line")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for f in flags:
            c.add_argument(f, action="store_true")
        return c

    c = command("ingest", "append the new mail of a folder")
    c.add_argument("root")
    c.add_argument("--archive", help="move files that were read there, zipped by day")
    c = command("ips", "look up addresses of origin", "--recheck")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--delay", type=float, default=4.5)
    c = command("domains", "look up sender domains of two messages or more", "--all", "--refill-missing")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--delay", type=float, default=8)
    c.add_argument("--whois", default=WHOIS, help="module:function")
    c = command("wallets", "look up wallets and their transactions", "--recheck")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--delay", type=float, default=2)
    c = command("log-action", "note what was done about a target", "--list")
    for name in ("action", "target_type", "target"):
        c.add_argument(name, nargs="?", default="")
    for name, value in (("--reference", ""), ("--status", "submitted"), ("--notes", ""), ("--date", "")):
        c.add_argument(name, default=value)
    c = command("mark-triage", "take a message off the triage queue", "--list")
    c.add_argument("id", nargs="?", default="")
    c.add_argument("status", nargs="?", default="reviewed")
    c.add_argument("--notes", default="")
    c = command("report", "write the JSON document, the sheets or the workbook", "--workbook")
    c.add_argument("out")
    c.add_argument("--sheets", action="store_true", help="a folder of one CSV table a sheet")
    c = command("publish", "ingest, look up and report", "--skip-ingest", "--skip-lookups")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--whois", default=WHOIS, help="module:function")
    c.add_argument("--sheets", help="write the sheets there, too")
    return p


def _domains(whois: str):
    module, _, name = whois.partition(":")
    return explorers.domain_client(getattr(import_module(module), name))


def main(argv: list[str], spark: SparkSession) -> object:
    """Run one command; returns what it has to say."""
    a = parser().parse_args(argv)
    store = Store(spark, a.store, self_addresses(a.self_addresses) if a.self_addresses else [])
    today = datetime.date.today().isoformat()
    if a.command == "ingest":
        return {r.category: r.messages for r in store.ingest(a.root, a.archive).collect()}
    if a.command == "ips":
        return store.look_up_ips(explorers.ip_client(), today, a.recheck, a.limit, a.delay)
    if a.command == "domains":
        return store.look_up_domains(_domains(a.whois), 1 if a.all else 2, a.limit, a.refill_missing, a.delay)
    if a.command == "wallets":
        return store.look_up_wallets(explorers.wallet_client(), today, a.recheck, a.limit, a.delay)
    if a.command in ("log-action", "mark-triage"):
        name = "actions" if a.command == "log-action" else "triage"
        if a.list:
            return [r.asDict() for r in store.table(name).orderBy("seq").collect()]  # a log kept by hand
        if name == "triage":
            return tables.mark_triage(spark, store.path(name), a.id, a.status, a.notes)
        return tables.log_action(spark, store.path(name), a.action, a.target_type, a.target, a.reference, a.status, a.notes, a.date)
    if a.command == "report" and a.sheets:
        return store.sheets(a.out)
    if a.command == "report" and a.workbook:
        with open(a.out, "wb") as f:
            return store.workbook(f)
    if a.command == "report":
        with open(a.out, "w", encoding="utf-8") as f:
            return store.document(f.write)
    skip = ("ingest",) * a.skip_ingest + ("ips", "domains", "wallets") * a.skip_lookups
    return publish(store, a.root, a.out, {"ips": explorers.ip_client(), "domains": _domains(a.whois), "wallets": explorers.wallet_client()}, today, skip, a.sheets)


if __name__ == "__main__":
    import sys

    said = main(sys.argv[1:], SparkSession.builder.appName("siftline").getOrCreate())
    if said is not None:
        print(said)
