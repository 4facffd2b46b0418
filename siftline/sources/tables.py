"""Tables on disk: text tables with a fixed schema, append-only logs, report folders and the JSON document.

A table that does not exist is empty.  A table with columns that the schema
lacks is refused; columns that the table lacks are blank.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.plans import messages as M

#: Columns of the tables, in order (fixed values).
SCHEMAS = {
    "messages": M.COLUMNS,
    "urls": M.URL_COLUMNS,
    "domain_enrichment": "domain registered_date registrar nameservers registrant_org registrant_country notes".split(),
    "ip_enrichment": "ip asn as_name isp org country country_code reverse_dns checked_date notes".split(),
    "wallet_enrichment": "address chain tx_count total_received balance first_seen last_seen checked_date explorer_url chainabuse_url notes".split(),
    "wallet_transactions": "address chain txid timestamp block_height direction amount counterparty_addresses confirmed tx_explorer_url".split(),
    "actions": "date action target_type target reference status notes".split(),
    "triage": "id status date notes".split(),
}
TARGET_TYPES = ("wallet", "domain", "ip", "asn", "url", "email", "phone", "other")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with exactly these text columns; a missing one is blank, an unknown one an error."""
    unknown = sorted(set(df.columns) - set(columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header, quoted line ends included; all text, null as blank."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return conform(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), columns)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table; arrays are joined by ``"; "`` and booleans are ``True`` or ``False``."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def flat(df: DataFrame) -> DataFrame:
    return df.select(*flat_columns(df).values())


def flat_columns(df: DataFrame) -> dict[str, Column]:
    """Each column as text: arrays joined by ``"; "``, booleans as ``True`` or ``False``, null as blank."""

    def text(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        if kind.startswith("array<string"):
            return F.array_join(x, "; ")
        return F.when(x, "True").when(~x, "False") if kind == "boolean" else x.cast("string")

    return {c: F.coalesce(text(c, kind), F.lit("")).alias(c) for c, kind in df.dtypes}


def lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Joined columns as arrays again; an item that holds ``;`` is cut in two."""
    return df.withColumns({c: C.split_list(F.col(c)) for c in columns})


def replace(df: DataFrame, path: str) -> None:
    """Write the Parquet table ``path`` anew, so that ``df`` may read it.

    The new table is written beside the old one, which is moved aside, and is
    deleted only when the new one has its name; if that fails, the old one gets
    its name back.
    """
    spark = df.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    new, aside = (at(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(new.toString())
    fs, place = _file_system(spark, path)
    had = fs.exists(place)
    if had and not fs.rename(place, aside):
        raise OSError(f"can't move {path} aside")
    try:
        if not fs.rename(new, place):
            raise OSError(f"can't move {new.toString()} to {path}")
    except Exception:
        if had:
            fs.rename(aside, place)
        raise
    if had:
        fs.delete(aside, True)


def migrate(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """Give the Parquet table ``path`` the text columns that it lacks, blank for its rows; a column that is not known is an error."""
    if not exists(spark, path):
        return False
    df = spark.read.parquet(path)
    if df.columns == columns:
        return False
    replace(conform(df, columns), path)
    return True


# Append-only logs


def read_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All rows of the log ``actions`` or ``triage``, with ``seq`` in order of appending."""
    schema = ", ".join(f"{c} string" for c in SCHEMAS[name]) + ", seq long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, name: str, row: dict[str, str]) -> None:
    last = read_log(spark, path, name).agg(F.max("seq")).first()[0]
    values = tuple(row.get(c) or "" for c in SCHEMAS[name]) + ((-1 if last is None else last) + 1,)
    spark.createDataFrame([values], ", ".join(f"{c} string" for c in SCHEMAS[name]) + ", seq long").write.mode("append").parquet(path)


def log_action(spark: SparkSession, path: str, action: str, target_type: str, target: str, reference: str = "", status: str = "submitted", notes: str = "", date: str = "") -> None:
    """Append an action; ``date`` is today if blank."""
    if target_type not in TARGET_TYPES:
        raise ValueError(f"target type {target_type!r} is none of {', '.join(TARGET_TYPES)}")
    _append(spark, path, "actions", {"date": date or datetime.date.today().isoformat(), "action": action, "target_type": target_type, "target": target, "reference": reference, "status": status, "notes": notes})


def mark_triage(spark: SparkSession, path: str, message_id: str, status: str = "reviewed", notes: str = "", date: str = "") -> None:
    """Append a triage mark; any status takes the message off the queue, and ids are not checked."""
    _append(spark, path, "triage", {"id": message_id, "status": status, "date": date or datetime.date.today().isoformat(), "notes": notes})


# Reports


def write_report(relations: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per relation, each replaced."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_documents(relations: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines per relation, for documents larger than one file."""
    for name, df in relations.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder.rstrip('/')}/{name}")


def json_document(entries: dict[str, object], write: Callable[[str], object]) -> None:
    """One compact JSON document, passed to ``write`` piece by piece.

    An entry is a plain value, or rows and their order: ``(DataFrame, columns)``,
    descending with a leading ``-``, and after them names of columns that are
    left out.  Rows are sorted by Spark and come to the driver a partition at a
    time, so that only one partition is held.
    """
    for n, (name, value) in enumerate(entries.items()):
        write(("," if n else "{") + json.dumps(name) + ":")
        if not isinstance(value, tuple):
            write(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
            continue
        df, order, *hidden = value
        rows = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]) if order else df
        text = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in sum(map(list, hidden), [])]), {"ignoreNullFields": "false"}).alias("j"))
        write("[")
        for i, row in enumerate(text.toLocalIterator()):
            write(("," if i else "") + row.j)
        write("]")
    write("}" if entries else "{}")
