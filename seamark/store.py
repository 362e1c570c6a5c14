"""The stored search index: chunks, postings, dictionary and trigram postings as tables that a query prunes to its own terms.

Postings and trigrams are lists by word for each batch of their input, in folders by a hash of the word, so a query reads the folders of its terms. Each task that builds
them writes to all folders as its batches come: building sorts and shuffles no postings, and what it writes grows with the text. A frequent word has rows in the files of
every task, so it makes no single large one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import inverted
from .operators import lexical
from .session import scratch

#: Bytes of a row group. A task writes to as many files at once as there are buckets, and each holds a group in memory.
GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class SearchIndex:
    """chunks; postings(lexeme, element_id, site_id, section_id, chunk, fifths); terms(term, df); grams(gram, term, df)."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    grams: DataFrame


def _store(lists: DataFrame, folder: str) -> DataFrame:
    """Writes lists by bucket, each task a file a bucket, all open at once: neither shuffle nor sort."""
    spark = lists.sparkSession
    open_files = {"spark.sql.maxConcurrentOutputFileWriters": str(inverted.BUCKETS + 1), "spark.sql.optimizer.plannedWrite.enabled": "false"}  # a planned write sorts first
    before = {k: spark.conf.get(k) for k in open_files}
    try:
        for k, v in open_files.items():
            spark.conf.set(k, v)
        lists.write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(lists.schema).parquet(folder)


def matching(table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The rows of these keys; both filters reach the scan, the first prunes folders, the second row groups."""
    if not values:
        return table.limit(0).drop("bucket")
    buckets = sorted({inverted.bucket_of(v) for v in values})
    return table.filter(F.col("bucket").isin(buckets) & F.col(key).isin(values)).drop("bucket")


def build(chunks: DataFrame) -> SearchIndex:
    """Writes the index of chunks(element_id, site_id, section_id, chunk, title, body) to the shared folder. Words are cut once, for postings; the dictionary is a sum over those."""
    spark: SparkSession = chunks.sparkSession
    folder = scratch(spark, "index")
    chunks.write.parquet(f"{folder}/chunks")
    stored = spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
    lists = _store(lexical.posting_lists(stored), f"{folder}/postings")
    lists.filter(F.length("lexeme") >= 3).groupBy(F.col("lexeme").alias("term")).agg(F.sum("occurrences").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    terms = spark.read.schema("term string, df long").parquet(f"{folder}/terms")
    grams = _store(lexical.trigram_lists(terms), f"{folder}/grams")
    hits = lists.select("bucket", "lexeme", F.inline("hits")).withColumnRenamed("weight", "fifths")
    return SearchIndex(stored, hits, terms, grams.select("bucket", "gram", F.inline("hits")).drop("weight"))


_built: dict[tuple[str, str], SearchIndex] = {}


def once(chunks: DataFrame, name: str) -> SearchIndex:
    """The index of chunks, built once an application under this name."""
    key = (chunks.sparkSession.sparkContext.applicationId, name)
    if key not in _built:
        _built[key] = build(chunks)
    return _built[key]
