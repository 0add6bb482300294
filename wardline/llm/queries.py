"""The operators as queries with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wardline.llm import align, chat_format, decontaminate, filter_audit, fingerprint, language_id, line_dedup, mixing, near_dedup, secret_scan, substring_dedup, token_count, token_files
from wardline.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.op1_token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op2_fingerprints(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op3_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op4_secret_scan(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5_decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_mixing(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7_line_dedup(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8_language_id(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op9_near_dedup(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op10_substring_dedup(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op11_chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op12_filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.op13_tokenizer_alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 reads of each document and its edited text, as SQL can tell it."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's findings by fixed patterns, counted, as SQL can tell them."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


FINGERPRINT_TEXTS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(next, length(t) // 4)) AS edited_sha256 FROM n
"""
SECRET_COUNTS_SQL = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_filter_audit": op12_filter_audit,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "fingerprint_texts": fingerprint_texts,
    "secret_counts": secret_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op11_chat_format": chat_format.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "fingerprint_texts": FINGERPRINT_TEXTS_SQL,
    "secret_counts": SECRET_COUNTS_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
