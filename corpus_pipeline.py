"""Corpus pipeline: toxic documents go, near duplicates and repeated passages go, sources are mixed and the mixture is packed.

Each stage takes the documents that the stage before kept and returns the same
columns, the last one the packed pieces.

Defined results: a null text counts as empty: it is scored as an empty
sentence, empty texts are copies of each other, and pack to the end token.  Of
near duplicates the smallest id stays; rows that repeat an id and text are one
row after that stage, and a null id is the smallest.  Texts of any length are
read whole; an empty table gives empty results; extra columns pass through
whatever their names, up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import mixing, packing, resemblance, substring, toxicity
from siftline.llm.common import materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on all labels scores under 0.3."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest id; all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more are linked."""
    return resemblance.representatives(docs, shingle=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by twenty-word windows that start earlier; the number of characters follows the text."""
    return substring.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.emit(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a small cache of words: the workers live on beside the other stages' memory."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=150_000, slice_bytes=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Near duplicates, the trained model and the tokenizer can't be expressed in SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
