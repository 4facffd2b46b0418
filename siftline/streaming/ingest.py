"""Mail appended to a message table: in one run over a folder, or as a stream of its new files.

Every writer draws a number of its own and writes to ``run=<number>/batch=N``, so
no writer can touch another's rows; ``seq`` of its messages begins at the number
times ``RUN_SEQ``.  A stream keeps its number beside its checkpoint: a batch that
is run again writes over its own folder, and a stream whose checkpoint is lost is
a new writer.  Links are written before messages, and count only where their
message is there, so a run that broke off between the two leaves no trace.

A single run leaves out the ids of the whole table.  A stream keeps the ids that
it has seen as keyed state, in a RocksDB store that survives restarts, and reads
the messages of other writers as a second stream, each file once; so what a batch
costs doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from siftline.operators.graph import numbered
from siftline.operators.scratch import drop, saved
from siftline.plans import messages as M
from siftline.sources import files, mail, tables

#: ``seq`` of a writer's messages begins at its number times this.
RUN_SEQ = 1 << 40
_KIND = {c: "array<string>" for c in M.LISTS} | {c: "int" for c in M.NUMBERS} | {"list_unsubscribe": "boolean"}
SCHEMA = ", ".join(f"{c} {_KIND.get(c, 'string')}" for c in M.COLUMNS) + ", seq long"
URL_SCHEMA = "id string, seq long, position int, url string, domain string"
_PLACE = ["run", "batch"]
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    schema += ", run int, batch long"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def read_messages(spark: SparkSession, table: str, run: int | None = None, batch: int | None = None) -> DataFrame:
    """The message table with ``seq``, or one batch of a writer; empty if there is none."""
    if run is not None:
        return spark.read.schema(SCHEMA).parquet(f"{table}/run={run}/batch={batch}")
    return _read(spark, table, SCHEMA).drop(*_PLACE)


def read_links(spark: SparkSession, urls: str, table: str) -> DataFrame:
    """The links of messages that are in ``table``."""
    there = _read(spark, table, SCHEMA).select("id", *_PLACE)
    return _read(spark, urls, URL_SCHEMA).join(there, ["id", *_PLACE], "left_semi").drop(*_PLACE).select(*[c.split()[0] for c in URL_SCHEMA.split(", ")])


def _write(spark: SparkSession, found: DataFrame, table: str, urls: str | None, run: int, batch: int, first_seq: int) -> DataFrame:
    """Number new messages and write them, links first; returns a copy of them."""
    new = saved(numbered(found, [F.col("path"), F.col("position")], "seq", first_seq), "new")
    at = f"run={run}/batch={batch}"
    if urls:
        M.links(new).write.mode("overwrite").parquet(f"{urls}/{at}")
    new.select(*M.COLUMNS, "seq").write.mode("overwrite").parquet(f"{table}/{at}")
    return new


def append(spark: SparkSession, root: str, table: str, urls: str | None = None, paths: list[str] | None = None, self_addresses: list[str] = (), ages: DataFrame | None = None) -> DataFrame:
    """Append the new messages of a folder, or of its files ``paths``, each id once; returns the run in numbers.

    ``(category, messages)``: new messages by category, and under ``files``,
    ``duplicates`` and ``unreadable`` what was scanned and what was left out.
    Each message is parsed once.  Links go to the table ``urls``.
    """
    run = files.claim_run(spark, table)
    parsed = saved(mail.read_mail(spark, root, paths), "parsed")
    found = saved(M.from_signals(mail.signals(parsed, self_addresses, ages)), "signals")
    new = _write(spark, mail.new_messages(found, read_messages(spark, table)), table, urls, run, 0, run * RUN_SEQ)
    n = F.count(F.lit(1)).alias("n")
    new_rows, found_rows = new.agg(n).first().n, found.agg(n).first().n
    of_files = parsed.agg(F.countDistinct("path").alias("n"), F.count("error").alias("broken")).first()
    rows = [(r.category, r.n) for r in new.groupBy("category").agg(n).orderBy("category").collect()]  # a handful of categories
    for copy in (parsed, found, new):
        drop(copy)
    return spark.createDataFrame([*rows, ("files", of_files.n), ("duplicates", found_rows - new_rows), ("unreadable", of_files.broken)], "category string, messages long")


def _first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first copy, by path and position, of an id that was never seen."""
    known, best = state.exists, None
    for f in frames:
        known = known or bool(f["known"].any())
        for copy in f.loc[~f["known"].astype(bool), ["path", "position", "row"]].itertuples(index=False, name=None):
            best = copy if best is None or copy[:2] < best[:2] else best
    if not state.exists:
        state.update((True,))
    if best is not None and not known:
        yield pd.DataFrame({"row": [best[2]]})


def _run_of(spark: SparkSession, table: str, checkpoint: str) -> int:
    """The stream's number, drawn when its checkpoint is made."""
    place = f"{checkpoint}.run"
    run = files.read_number(spark, place) if tables.exists(spark, checkpoint) else None
    if run is None:
        run = files.claim_run(spark, table)
        files.write_number(spark, place, run)
    return run


def ingest(
    spark: SparkSession, root: str, table: str, checkpoint: str, self_addresses: list[str] = (), urls: str | None = None, files_at_once: int = 10_000, ages: Callable[[], DataFrame | None] | None = None
) -> StreamingQuery:
    """Append the messages of files that came since the last run to the Parquet table ``table``, each id once.

    ``ages`` is called for each batch, so registrations that were looked up
    meanwhile count from the next batch on.  Unreadable mail is left out.
    """
    run = _run_of(spark, table, checkpoint)
    if spark.conf.get(_STORE, "").endswith("HDFSBackedStateStoreProvider"):  # Spark's default, which holds all keys in memory
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parsed = mail.stream_mail(spark, root, files_at_once).where("error IS NULL")
    row = F.to_json(F.struct(*[F.col(c) for c in mail.PARSED.fieldNames()]))
    mails = parsed.select(mail.message_key().alias("id"), F.lit(False).alias("known"), "path", "position", row.alias("row"))
    others = spark.readStream.schema("id string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreMissingFiles", True).parquet(table)
    others = others.select("id", F.lit(True).alias("known"), F.lit("").alias("path"), F.lit(0).cast("long").alias("position"), F.lit("").alias("row"))
    key = F.when(F.col("id") != "", F.col("id"))  # of one type, nullable, whichever of the two streams has rows: the state's schema may not change
    fresh = mails.unionByName(others).withColumn("id", key).groupBy("id").applyInPandasWithState(_first, "row string", "seen boolean", "append", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = saved(batch, "stream")  # the state is asked once
        first_seq = files.read_number(own, f"{table}/_runs/{run}-{number}") or run * RUN_SEQ
        given = rows.select(F.from_json("row", mail.PARSED).alias("x")).select("x.*")
        new = _write(own, M.from_signals(mail.signals(given, self_addresses, ages() if ages else None)), table, urls, run, number, first_seq)
        files.write_number(own, f"{table}/_runs/{run}-{number + 1}", first_seq + new.count())
        drop(rows)
        drop(new)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
