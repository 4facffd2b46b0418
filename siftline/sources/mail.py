"""Mail files as a DataFrame: a scan of a folder, one row per message, and the projection to signals.

Single mails are read by Spark's binary file source, each by one task, and must
stay under 2 GB.  Mailboxes are read as text that is cut at the lines that
begin a message, so Spark splits a mailbox of any size over tasks and only one
message is held at a time.  A message that can't be read keeps its row, with
``error`` set, and never fails the job; an empty file holds no message, and
Spark skips it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftline.functions import columns as C
from siftline.functions import parsing
from siftline.operators.triage import triage

FILE = "path string, modificationTime timestamp, length long, content binary"
#: Bytes of mail whose parsed rows a task holds before it gives them out.
BATCH = 16 << 20
_TEXT = "message_id date sender raw_subject date_iso subject from_name from_addr from_domain return_path reply_to_addr reply_domain auth body body_template_fingerprint".split()
_LISTS = "received links image_sources link_mismatches phones phones_functional emails_functional".split()
_IMAGE = T.StructType([*[T.StructField(x, T.StringType()) for x in ("name", "hash", "phash", "type")], T.StructField("size", T.LongType())])
PARSED = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("source", T.StringType()), T.StructField("position", T.LongType()), T.StructField("error", T.StringType()), T.StructField("list_unsubscribe", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
    + [T.StructField("images", T.ArrayType(_IMAGE)), T.StructField("image_ocr_chars", T.IntegerType())]
)


def source_tag(path: Column, root: str) -> Column:
    """The first folder of a path below ``root``; ``input`` for files in ``root`` itself."""
    below = F.split(F.substring_index(path, "/" + root.rstrip("/").rpartition("/")[2] + "/", -1), "/")
    return F.when(F.size(below) > 1, below[0]).otherwise("input")


class _Rows:
    """Parsed messages, given out in record batches of about ``BATCH`` bytes of mail."""

    schema = to_arrow_schema(PARSED)
    blank = {f.name: None for f in PARSED.fields}

    def __init__(self, headers_only: bool = False, as_shown: bool = False):
        self.headers_only, self.as_shown = headers_only, as_shown
        self.rows: list[dict] = []
        self.held = 0

    def add(self, path: str, source: str, position: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        row = self.blank | {"path": path, "source": source, "position": position}
        try:
            row |= parsing.parse(raw, self.headers_only, self.as_shown)
        except Exception as e:  # noqa: BLE001  the row says what went wrong
            row["error"] = f"{type(e).__name__}: {e}"
        self.rows.append({k: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for k, v in row.items()})
        self.held += len(raw)
        if self.held >= BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.held = [], 0


def parse_files(files: DataFrame, root: str, headers_only: bool = False, as_shown: bool = False) -> DataFrame:
    """One row per message of whole files ``(path, content)``; if only headers are asked for, what comes from bodies is null; ``as_shown`` is that of :func:`siftline.functions.parsing.parse`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(headers_only, as_shown)
        for b in batches:
            for i in range(b.num_rows):
                path, source, content = (b.column(k)[i].as_py() for k in range(3))
                for n, raw in enumerate(parsing.split_mailbox(content) if path.lower().endswith(".mbox") else [content]):
                    yield from out.add(path, source, n, raw)
        yield from out.rest()

    mail = files.where(F.lower("path").rlike(r"\.(eml|mbox)$"))
    return mail.select("path", source_tag(F.col("path"), root).alias("source"), "content").mapInArrow(run, PARSED)


def parse_records(records: DataFrame, root: str) -> DataFrame:
    """One row per message of mailbox records ``(path, block, content)``, as they lie in a scan that cuts mailboxes before each message.

    ``block`` is where the record's split of the file begins, which keeps
    ``position`` rising over a file.  What precedes the first message of a file is no message.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, n = _Rows(), None, 0
        for b in batches:
            for i in range(b.num_rows):
                path, source, block, raw = (b.column(k)[i].as_py() for k in range(4))
                start = (path, block) != last
                if start:
                    last, n = (path, block), 0
                if start and block == 0 and not raw.startswith(b"From "):
                    continue
                yield from out.add(path, source, block + n, raw.partition(b"\n")[2])
                n += 1
        yield from out.rest()

    return records.select("path", source_tag(F.col("path"), root).alias("source"), "block", "content").mapInArrow(run, PARSED)


def _scan(reader, where: list[str] | str, root: str) -> DataFrame:
    """Mail that a batch or stream reader finds; ``reader(format, glob)`` makes one."""
    files, boxes = reader("binaryFile", "*.[eE][mM][lL]"), reader("text", "*.[mM][bB][oO][xX]").option("lineSep", "\nFrom ")
    one = files.schema(FILE).load(where).select(F.col("_metadata.file_path").alias("path"), "content")
    many = boxes.load(where).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content"))
    return parse_files(one, root).unionByName(parse_records(many, root))


def read_mail(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """All mail below the folder ``root``, or that of the files ``paths`` in it."""
    return _scan(lambda kind, glob: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob), [root] if paths is None else paths, root)


def stream_mail(spark: SparkSession, root: str, files_at_once: int) -> DataFrame:
    """The mail of files that come to the folder ``root``, as a stream; single mails and mailboxes, ``files_at_once`` of each in a batch."""
    return _scan(lambda kind, glob: spark.readStream.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once), root, root)


def message_key() -> Column:
    """The id of a parsed message."""
    return C.message_id(*[F.col(c) for c in ("message_id", "date", "sender", "raw_subject")])


def signals(parsed: DataFrame, self_addresses: list[str] = (), ages: DataFrame | None = None) -> DataFrame:
    """The readable messages with ids, indicators and the verdict of the rules; ``ages``: ``(domain, age)`` in days, one row per domain."""
    c = F.col
    btc, eth = C.wallets(c("body"))
    d = parsed.where("error IS NULL").withColumns(
        {
            "id": message_key(),
            **{x: C.auth_result(c("auth"), x) for x in ("dkim", "spf", "dmarc")},
            "originating_ips": C.received_ips(F.array_join("received", "\n")),
            "urls": F.array_distinct(F.concat("links", C.urls(c("body")))),
            "remote_image_domains": F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("image_sources", lambda s: F.lower(s).startswith("http")), C.url_domain), lambda x: x != ""))),
            "btc_addresses": btc,
            "eth_addresses": eth,
            "contact_emails": C.contact_emails(c("body"), c("from_addr"), self_addresses),
            "impersonated_brands": C.brands(F.concat_ws("\n", "from_name", "subject", "body")),
            "display_name": c("from_name"),
        }
    )
    d = d.withColumns({"flags": C.url_flags(c("urls")), "n_mismatch": F.size("link_mismatches"), "n_wallets": F.size("btc_addresses") + F.size("eth_addresses")})
    d = d.withColumns({"contacts_functional": F.array_intersect("contact_emails", "emails_functional"), "phones_filler": F.array_sort(F.array_except("phones", "phones_functional"))})
    d = d.withColumn("contacts_filler", F.array_except("contact_emails", "contacts_functional")).drop("emails_functional")
    if ages is None:
        d = d.withColumns({"age": F.lit(None).cast("int"), "root_age": F.lit(None).cast("int")})
    else:
        one = lambda key, name: ages.select(F.col("domain").alias(key), F.col("age").cast("int").alias(name))
        d = d.withColumn("_r", C.root(c("from_domain"))).join(one("from_domain", "age"), "from_domain", "left").join(one("_r", "root_age"), "_r", "left").drop("_r")
    return triage(d)


def new_messages(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each id once, its first copy by path and position, and none that ``known`` has."""
    first = found.groupBy("id").agg(F.min(F.struct("path", "position")).alias("_first"))
    d = found.join(first.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.struct("path", "position") == F.col("_first"))).drop("_id", "_first")
    return d if known is None else d.join(known.select("id"), "id", "left_anti")
