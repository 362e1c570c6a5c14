"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_urlfilter, op2_simhash, op3_suffix, op4_archive, op5_chunks, op6_chat, op7_quality, op8_lines, op9_mixing, op10_decontaminate
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_urlfilter.filter_urls(table(spark, sf_dir, "pages"), op1_urlfilter.default_rules(spark))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_archive.round_trip(table(spark, sf_dir, "pages"))


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_chunks.containment(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_chat.format_chats(op6_chat.with_parts(table(spark, sf_dir, "conversations")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op7_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "quality_score", "toxic_score", "keep")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "probability")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    every = (op1_url_filter, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_warc_archive, op5_chunk_fingerprints, op6_chat_format, op7_quality_classifier, op8_line_dedup, op9_mix_sources, op10_benchmark_decontamination)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": op1_urlfilter.ORACLE,
        "op3_suffix_array_dedup": op3_suffix.ORACLE,
        "op4_warc_archive": op4_archive.ORACLE,
        "op6_chat_format": op6_chat.ORACLE,
        "op8_line_dedup": op8_lines.ORACLE,
    }
