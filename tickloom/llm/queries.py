"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, media, mergedrop, packing, passages, pivots, shingles, tokencount, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.join(table(spark, sf_dir, "documents"), least=0.8)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", licenses.document_path().alias("path"), "text")
    return licenses.scan(files, keep=("doc_id",))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencount.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mergedrop.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), seed=20, dropout=0.1)


#: A conversation whose texts hold the template's own marks.
PLANTED = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digest(chat.format_turns(rows.unionByName(planted)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media.media_digest(media.to_media(docs, "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), max_len=1024, end_id=0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_media_columns": op8_media_columns,
    "op9_packing": op9_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
}

#: Where SQL can express a query.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": passages.ORACLE,
    "op2_ngram_join": shingles.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op7_chat_formatting": chat.oracle(PLANTED),
    "op10_embedding_dedup": pivots.ORACLE,
}
