"""Queries of the subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lonepoint.llm import chat, hard_negatives, near_dedup, prefix_trie, substring_dedup, topk, url_filters
from lonepoint.llm.language import language_id
from lonepoint.llm.mixing import mix
from lonepoint.llm.near_dedup import near_duplicates
from lonepoint.llm.pii import find_pii
from lonepoint.llm.pieces import encode_digests
from lonepoint.llm.quality import quality
from lonepoint.llm.substring_dedup import without_repeats
from lonepoint.llm.toxicity import toxicity


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def piece_model(file: str | None = None) -> bytes:
    """Content of a SentencePiece model file, by default the public 32k BPE model."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("piece_bpe_32k.model")
    with open(file, "rb") as f:
        return f.read()


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode_digests(table(spark, sf, "documents"), piece_model())


def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_chats(table(spark, sf, "conversations"))


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(table(spark, sf, "documents"))


def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


def op6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(table(spark, sf, "documents"))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


def op9_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return url_filters.url_verdicts(pages, url_filters.RULES, url_filters.repeated_urls(pages))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.shifted_labels(table(spark, sf, "embeddings")))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


def op13_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id(table(spark, sf, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat": op3_chat,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_minhash": op6_minhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_id": op13_language_id,
}

ORACLE = {
    "op3_chat": chat.ORACLE,
    "op5_topk": topk.ORACLE,
    "op6_minhash": near_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
