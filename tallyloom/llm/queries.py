"""Queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat_format, decontaminate, line_dedup, lm_score, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_count
from tallyloom.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(read_table(spark, folder, "documents"), mode="all", min_docs=10)
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.dedup_repeats(read_table(spark, folder, "documents"), length=100)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, folder, "documents"), size=4, most_bits=4)


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel"
    )


#: What conversation -1 says in both of its turns.
CONFLICT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_conversations(chat_format.format_conversations(rows.union(more)))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge_documents(read_table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op9_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(
        read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode_bpe(
        read_table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decoded=True,
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    targets = read_table(spark, folder, "labels").where("quality = 1").select("doc_id")
    scored = lm_score.score_documents(read_table(spark, folder, "documents"), targets)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_simhash": op3_simhash,
        "op4_secret_scan": op4_secret_scan,
        "op5_chat_format": op5_chat_format,
        "op6_quality_rules": op6_quality_rules,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_count": op9_token_count,
        "op10_lm_score": op10_lm_score,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op5_chat_format": chat_format.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op10_lm_score": lm_score.ORACLE_SQL,
    }
