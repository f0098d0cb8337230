"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, filter_audit, line_dedup, merge_agenda, part_codes, repetition, separator_scan, simhash, skip_chain, trigram_scan, warc_store, wrappers, zstd_quality
from tessera.session import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: below TESSERA_TOKENIZERS if that is set, else of the installed package."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = skip_chain.personal_data(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = separator_scan.rank_tokenizer(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return separator_scan.token_counts(docs, scratch(spark, "tokens"), tokenizer, separator=50_256).select("doc_id", "n_tokens")


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.repetition(docs).select("doc_id", *repetition.MEASURES, "base_failed", "kept")


def op4_merge_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = merge_agenda.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = zstd_quality.learn(docs, table(spark, sf_dir, "labels"))
    return zstd_quality.score_quality(docs, model).select("doc_id", zstd_quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc_store.read_index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_found", "n_changed")


def op11_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trigram_scan.secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def op13_partial_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def queries() -> dict[str, Query]:
    every = (op1_skip_chain_pii, op2_separator_scan, op3_repetition_coverage, op4_merge_agenda, op5_zstd_quality, op6_warc_store, op7_simhash_variants, op8_line_dedup, op9_wrapper_text, op10_template_leaks, op11_trigram_secrets, op12_filter_audit, op13_partial_codes)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_store": warc_store.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_partial_codes": part_codes.ORACLE}
