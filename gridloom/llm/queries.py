"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard_join, pii, piece_counts, quality, substring_dedup, token_files, url_rules
from .common import table
from .tokenizers_io import public_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.self_check_rows(table(spark, sf_dir, "conversations"))
    out = chat.format_chat(rows, public_path("byte_bpe_50k.json"), digests=True)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, inner = piece_counts.sentence_pieces(public_path("piece_bpe_32k.model"))
    return piece_counts.count_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), initial, inner)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_path("byte_bpe_50k.json"), add=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.MEASURED, "base_failed", "kept", "posterior")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), token_files.scratch_path(spark))
    return token_files.read_documents(files)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.RULES).drop("url")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_chat_format, op2_token_counts, op3_bpe, op4_quality, op5_substring_dedup, op6_pii, op7_token_files, op8_jaccard_join, op9_url_filter, op10_decontaminate,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE_SQL, "op8_jaccard_join": jaccard_join.ORACLE_SQL, "op9_url_filter": url_rules.ORACLE_SQL}
