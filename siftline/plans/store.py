"""A folder of tables from mail to report: ingest, lookups, logs, and the report.

Messages and links are appended by writer and batch, ``messages/run=R/batch=N``.
Dimensions are replaced whole, written beside the old table first.  Actions and
triage marks are logs.  Partial relations of the report are kept by batch, so
that a report counts new messages only.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.scratch import drop, saved
from siftline.plans import enrichment as E
from siftline.plans import messages as M
from siftline.plans import partials, report
from siftline.sources import files, tables, workbook
from siftline.streaming import ingest

DIMENSIONS = ("domain_enrichment", "ip_enrichment", "wallet_enrichment", "wallet_transactions")
LOGS = ("actions", "triage")


def self_addresses(path: str) -> list[str]:
    """Addresses of a file, one a line; what follows a ``#`` and blank lines are no address."""
    with open(path, encoding="utf-8") as f:
        return [x for x in (line.partition("#")[0].strip().lower() for line in f) if x]


class Store:
    def __init__(self, spark: SparkSession, folder: str, own: list[str] = ()):
        self.spark, self.folder, self.own = spark, folder.rstrip("/"), list(own)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    # Reading

    def typed(self) -> DataFrame:
        """The message table as it is stored, with ``seq``."""
        return ingest.read_messages(self.spark, self.path("messages"))

    def messages(self) -> DataFrame:
        return M.relation(self.typed())

    def urls(self) -> DataFrame:
        return ingest.read_links(self.spark, self.path("urls"), self.path("messages"))

    def table(self, name: str) -> DataFrame:
        """A dimension or log; empty if it was never written."""
        if name in LOGS:
            return tables.read_log(self.spark, self.path(name), name)
        if not tables.exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in tables.SCHEMAS[name]))
        return tables.conform(self.spark.read.parquet(self.path(name)), tables.SCHEMAS[name])

    def dims(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in (*DIMENSIONS, *LOGS)} | {"urls": self.urls()}

    def replace(self, name: str, df: DataFrame) -> None:
        tables.replace(tables.conform(df, tables.SCHEMAS[name]), self.path(name))

    # Mail

    def ingest(self, root: str, archive: str | None = None, day: str = "") -> DataFrame:
        """Append the new mail of a folder; ``archive``: a folder to which the files that were read move, zipped by day."""
        paths = files.mail_files(self.spark, root) if archive else None
        ages = E.domain_ages(self.table("domain_enrichment"))
        run = ingest.append(self.spark, root, self.path("messages"), self.path("urls"), paths, self.own, ages) if paths != [] else self.spark.createDataFrame([], "category string, messages long")
        if archive:
            files.archive(self.spark, paths, root, archive, day or datetime.date.today().isoformat())
            files.zip_days(self.spark, archive)
        return run

    def stream(self, root: str, checkpoint: str, files_at_once: int = 10_000) -> StreamingQuery:
        """Append the mail that came to a folder since the stream's last run; ages are those known when a batch begins."""
        ages = lambda: E.domain_ages(self.table("domain_enrichment"))
        return ingest.ingest(self.spark, root, self.path("messages"), checkpoint, self.own, self.path("urls"), files_at_once, ages)

    # Lookups

    def look_up_ips(self, client: Callable, checked: str, recheck: bool = False, limit: int = 0, delay: float = 4.5) -> int:
        """Ask about addresses that are not known yet; returns how many rows came."""
        old, found = self.table("ip_enrichment"), E.candidate_ips(self.messages())
        asked = E.to_look_up(found, old, "ip", recheck, limit, "first_seq")
        rows = saved(E.ip_rows(E.look_up(asked.repartition(1), "ip", client, 100, delay), checked), "ips")
        n = rows.count()
        if n:
            self.replace("ip_enrichment", E.keep_candidates(E.replace_rows(old, rows, "ip"), found, "ip"))
        return n

    def look_up_domains(self, client: Callable, at_least: int = 2, limit: int = 0, refill: bool = False, delay: float = 8) -> int:
        """Ask about sender domains of ``at_least`` messages, and with ``refill`` again about known ones without name servers."""
        old = self.table("domain_enrichment")
        asked = E.to_look_up(E.candidate_domains(self.messages(), at_least), old, "domain").select(F.lit(0).alias("o"), "domain")
        if refill:
            asked = asked.unionByName(E.without_nameservers(old).select(F.lit(1).alias("o"), "domain"))
        asked = asked.orderBy("o", "domain").limit(limit) if limit else asked
        answers = saved(E.look_up(asked.select("domain").repartition(1), "domain", client, 1, delay), "whois")
        rows = E.domain_rows(answers).unionByName(E.failed_domains(answers))
        n = rows.count()
        if n:
            self.replace("domain_enrichment", E.fill_in(old, rows, "domain"))
        return n

    def look_up_wallets(self, client: Callable, checked: str, recheck: bool = False, limit: int = 0, delay: float = 2) -> int:
        """Ask about wallets that are not known yet, and keep their transactions."""
        old, past = self.table("wallet_enrichment"), self.table("wallet_transactions")
        found = E.candidates(self.messages(), ["btc", "eth"]).groupBy(F.col("value").alias("address")).agg(F.min("first_seq").alias("first_seq"), F.min_by(F.upper("kind"), "first_seq").alias("chain"))
        asked = E.to_look_up(found, old, "address", recheck, limit, "first_seq")
        answers = saved(E.look_up(asked.select(F.concat_ws(":", "chain", "address").alias("wallet")).repartition(1), "wallet", client, 1, delay), "wallets")
        rows = saved(E.wallet_rows(answers, checked), "rows")
        n = rows.count()
        if n:
            new = E.wallet_transactions(answers).select(*[F.col(c).cast("string").alias(c) if c != "confirmed" else F.initcap(F.col(c).cast("string")).alias(c) for c in tables.SCHEMAS["wallet_transactions"]])
            self.replace("wallet_transactions", E.replace_transactions(past, new, rows))
            self.replace("wallet_enrichment", E.replace_rows(old, rows, "address"))
        return n

    # Report

    def count(self, at_most: int = 64) -> int:
        """Add the batches of messages that are not counted yet to the partial relations; returns how many there were.

        Each is read once, by itself; more than ``at_most`` counted ones are merged.
        """
        kept, table = partials.ReportPartials(self.spark, self.path("partials")), self.path("messages")
        new = [(run, batch) for run, batch in files.batches(self.spark, table) if f"r{run}b{batch}" not in kept.names()]
        for run, batch in new:
            mine = ingest.read_messages(self.spark, table, run, batch)
            kept.add(M.relation(mine), f"r{run}b{batch}")
        if kept.batches() > at_most:
            kept.compact()
        return len(new)

    def document(self, write: Callable[[str], object], generated_at: str = "", counted: bool = False) -> None:
        """The JSON document, written piece by piece; ``counted``: with grouped relations of what :meth:`count` keeps, brought up to date first."""
        now, dims = generated_at or datetime.datetime.now(datetime.timezone.utc).isoformat().replace("+00:00", "Z"), self.dims()
        if counted:
            self.count()
            kept = {name: saved(df, name) for name, df in partials.ReportPartials(self.spark, self.path("partials")).tables().items()}
            numbers = partials.counts(kept, dims["ip_enrichment"])
            tables.json_document(report.document(self.messages(), dims, now, (numbers, partials.relations(kept, dims))), write)
            for copy in kept.values():
                drop(copy)
            return
        m = saved(self.messages(), "messages")
        tables.json_document(report.document(m, dims, now), write)
        drop(m)

    def sheets(self, folder: str) -> None:
        """The sheets of the workbook, one table each."""
        m = saved(self.messages(), "messages")
        report.write_sheets(m, self.dims(), lambda name, df: tables.write_csv(df, f"{folder.rstrip('/')}/{name}"))
        drop(m)

    def workbook(self, out: BinaryIO) -> list[str]:
        """The sheets as one workbook file, written row by row; returns their names."""
        m = saved(self.messages(), "messages")
        names = workbook.write(report.sheet_rows(m, self.dims()), out)
        drop(m)
        return names


def publish(store: Store, root: str, out: str, clients: dict[str, Callable], today: str, skip: tuple[str, ...] = (), sheets: str | None = None) -> dict[str, str]:
    """All steps in order: ingest, the three lookups, which may fail, the document, written to the file ``out``, and the sheets, if a folder is given.

    ``clients``: by ``ips``, ``domains`` and ``wallets``; a lookup without one is skipped.
    """

    def write() -> None:
        os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
        with open(out, "w", encoding="utf-8") as f:
            store.document(f.write)

    steps = {
        "ingest": lambda: store.ingest(root), "ips": lambda: store.look_up_ips(clients["ips"], today), "domains": lambda: store.look_up_domains(clients["domains"]),
        "wallets": lambda: store.look_up_wallets(clients["wallets"], today), "report": write,
    }
    if sheets:
        steps["sheets"] = lambda: store.sheets(sheets)
    absent = tuple(x for x in ("ips", "domains", "wallets") if x not in clients)
    return report.run_steps(steps, (*skip, *absent), ("ips", "domains", "wallets"))
