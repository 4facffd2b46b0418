"""Token counts with a cache of digests: only texts that were never counted before are encoded.

A text is known by the digest of its normalised content, and a tokenizer by the
digest of its file, its library and that library's version, so a changed
tokenizer never meets counts of the old one.  Digests of all documents are
joined with the stored ones; one text of each digest that is missing is encoded,
and its count is appended to the cache, a folder of Parquet files for each
version.  A count that was appended twice, by two jobs at once, counts once.

Normalising folds A-Z and squeezes ASCII white space only where the tokenizer
gives ``PROBES`` the same ids either way; a text that holds one of its added
tokens, in any case, is taken as it is.

Texts move to other tasks once.  With a warm cache, when at most one digest in
ten is missing and these are few enough for a broadcast, they don't move at all.

Defined results: a null text counts as empty, and an empty text has no tokens;
rows that repeat an id or a text each get their count; a null id stays null; an
empty table gives an empty result and leaves the cache as it was; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.scratch import folder
from siftline.sources.tables import exists

from .common import materialise, raw_texts, sliced
from .packing import PROBES, WordTokeniser

#: Missing digests up to which they are broadcast: 56 bytes each.
BROADCAST_ROWS = 100_000
#: Digests that an encoding task remembers, so that repeated rows are encoded once.
SEEN = 100_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 500_000
CACHE = "digest binary, n_tokens long"


class Counter:
    """Counts tokens and normalises texts for the tokenizer file ``path``: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    shared: dict[str, Counter] = {}

    def __init__(self, path: str):
        self.path, self.special = path, []
        if path.endswith(".json"):
            words = WordTokeniser.at(path)
            words.most = CACHE_WORDS
            self.special = [x.encode().lower() for x in words.special]
            self.ids = words.ids
            self.width = words.width
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: [b"\0" * len(x) for x in model.encode(texts, num_threads=1)]
            self.same = lambda texts: model.encode(texts, num_threads=1)
            self.width = 1
        else:
            raise ValueError(f"{path}: neither .json nor .model")
        same = getattr(self, "same", self.ids)
        plain = same(PROBES)
        self.fold = same([_fold(p.encode()).decode() for p in PROBES]) == plain
        self.squeeze = same([_squeeze(p.encode()).decode() for p in PROBES]) == plain

    @classmethod
    def at(cls, path: str) -> Counter:
        """The one of this process."""
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // self.width for x in self.ids(texts)]

    def normalise(self, raw: bytes) -> bytes:
        """Equal for two texts only if they have the same tokens."""
        low = raw.lower()
        if any(x in low for x in self.special):
            return b"=" + raw
        x = low if self.fold else raw
        return b"~" + (_squeeze(x) if self.squeeze else x)


def _fold(raw: bytes) -> bytes:
    return raw.lower()  # A-Z only, as these are bytes


def _squeeze(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def version(tokenizer_path: str) -> str:
    """Digest of what decides the tokens of a text: the file, the library and its version."""
    library = "tokenizers" if tokenizer_path.endswith(".json") else "sentencepiece"
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f"{library} {library_version(library)} no special tokens\n".encode() + f.read()).hexdigest()


def _digests(docs: DataFrame, tokenizer_path: str, with_text: bool, id_col: str, text_col: str) -> DataFrame:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())] + [("text", pa.string())] * with_text
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(tokenizer_path)
        for b in sliced(batches):
            raw = raw_texts(b)
            digest = [hashlib.blake2b(counter.normalise(x), digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(digest, pa.binary())] + [b.column("text").cast(pa.string())] * with_text, schema=schema)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, digest binary" + ", text string" * with_text)


def _encoded(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = Counter.at(tokenizer_path), set()
        for b in sliced(batches):
            digest = b.column("digest").to_pylist()
            new = {d: i for i, d in enumerate(digest) if d not in seen}
            column = b.column("text")
            n = counter.counts([column[i].as_py() or "" for i in new.values()])
            seen = (seen if len(seen) < SEEN else set()) | new.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(n, pa.int64())], schema=schema)

    return texts.mapInArrow(run, CACHE)


def read_cache(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """``(digest, n_tokens)``, each digest once: what is stored for the tokenizer version ``of``."""
    place = f"{cache.rstrip('/')}/version={of}"
    stored = spark.read.schema(CACHE).parquet(place) if exists(spark, place) else spark.createDataFrame([], CACHE)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row; ``cache``: a folder that all executors share, kept for later calls; without one, a scratch folder."""
    spark, of = docs.sparkSession, version(tokenizer_path)
    cache = cache or f"{folder(spark)}/siftline-token-cache-{uuid.uuid4().hex}"
    own = materialise(_digests(docs, tokenizer_path, False, id_col, text_col), "digests")
    distinct = own.groupBy("digest").agg(F.min("doc_id").alias("of"))
    stored = read_cache(spark, cache, of).select("digest", F.lit(True).alias("known"))
    asked = materialise(distinct.join(stored, "digest", "left").select(F.col("digest").alias("_d"), "of", "known"), "asked")
    missing = asked.where("known IS NULL").drop("known")
    n = missing.count()
    if n:
        wanted = F.broadcast(missing) if n <= min(BROADCAST_ROWS, asked.count() // 10) else missing
        texts = _digests(docs, tokenizer_path, True, id_col, text_col)
        found = texts.join(wanted, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("digest", "text")
        _encoded(found, tokenizer_path).write.mode("append").parquet(f"{cache.rstrip('/')}/version={of}")
    counts = own.join(read_cache(spark, cache, of), "digest")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
