"""The corpus pipeline: quality, line dedup, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Further columns pass through whatever their names; an empty table gives an empty one; texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import op2_simhash, op7_quality, op8_lines, op9_mixing, op10_decontaminate
from seamark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: judged by their text alone, so copies share their lot, null and empty texts are judged as texts without words, and rows without doc_id like any other."""
    judged = op7_quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter(F.col(judged.columns[-1])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts frequent lines out of the texts; n_chars follows. A document that had text and has none left goes; null and empty texts stay as they are."""
    out = op8_lines.dedup_lines(docs)
    dropped = F.col(out.columns[-1])
    kept = out.filter((dropped == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(dropped == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies. Texts that are null or without words stay; rows without doc_id are judged by their text; repeated rows of one doc_id are one document."""
    return op2_simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a passage of the benchmark, with or without doc_id; null and empty texts stay."""
    return op10_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples to the target weights of source, language and topic; null sources and languages are a value of their own, texts without tokens are never sampled."""
    return op9_mixing.mix_sources(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]
#: SQL can't express the classifier or the near-duplicate search; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
