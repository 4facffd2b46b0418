"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, language, mixing, multiindex, packing, repetition, simhash, site_bayes, spelling, substring, suffixes, token_counts, toxicity
from .common import read


def _id_hash(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(_id_hash(5) == 0, F.lit(False))
    got = language.identify(docs, train=_id_hash(5) != 0)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(_id_hash(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    return got.select("doc_id", F.coalesce(_id_hash(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_sentences"))


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, and paths are a source's languages; learned from ids whose CRC-32 modulo 5 is not 0."""
    labels = read(spark, sf_dir, "labels").where(_id_hash(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return site_bayes.classify(read(spark, sf_dir, "documents"), labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op8_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"), with_rest=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def packing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing with target weights 5, 2, 1, repeating, by source in order of code points; a null source comes last."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    sources = [r.source for r in docs.select("source").distinct().orderBy(F.col("source").asc_nulls_last()).collect()]  # one row a source
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, weights={s: float((5, 2, 1)[i % 3]) for i, s in enumerate(sources)})


def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.summary(conversations.damage(rows), rows)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_language_mixture, op2_suffix_repetition, op3_simhash_ball, op4_seed_extend, op5_toxicity_mil, op6_inverted_multi_index, op7_site_quality, op8_systematic_mixing, op9_difference_cover, op10_mixture_packing, op11_errata_trie, op12_conversation_repair, op13_token_counts, packing_to_weights)}
SQL = {"op2_suffix_repetition": repetition.SQL, "op6_inverted_multi_index": multiindex.SQL, "op9_difference_cover": suffixes.SQL, "op4_seed_extend": substring.SQL, "op8_systematic_mixing": mixing.SQL}
