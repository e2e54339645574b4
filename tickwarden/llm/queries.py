"""Catalogue queries of the corpus operators.

Each takes ``(spark, sf_dir)``, applies its operator to the whole of its
table and returns the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.llm import (
    bytebpe, classifier, hardneg, langid, lm, mixing, packing, prefix_trie, quality_rules, simhash, tokenbin, topk, warc,
)
from tickwarden.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records in ZIP packages and read back by range."""
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 1,024 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    vectors = topk.searchable(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outlier distance of every document."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 within 150 % of all words."""
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document (four decimals)."""
    rounded = F.floor(F.col("log_score") * 10000.0 + 0.5).cast("double") / 10000.0
    return lm.score(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "backed_off", rounded.alias("log_score")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classifier.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as compressed token-id files and read back."""
    return tokenbin.round_trip(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the bytes that they decode to, as digests."""
    return bytebpe.round_trip(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 50 to 95 % of an anchor's positives."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return hardneg.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_best_fit_packing, op3_exact_top_k, op4_quality_rules, op5_mixing, op6_language_id,
        op7_lm_scoring, op8_quality_classifier, op9_simhash, op10_token_ids, op11_prefix_trie, op12_byte_bpe,
        op13_hard_negatives,
    )
}
