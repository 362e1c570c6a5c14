"""Line deduplication over the corpus.

Lines are normalised (case, runs of blanks), hashed, and counted by distinct documents. A line that more than
`least_docs` documents have (and more than `share` of them, if that is set) is dropped everywhere; the other lines keep their order and spelling.

Two passes over the texts: the first sends only (hash, document) pairs, unique within a document, to be counted; the second sends
hashes and positions to the (few) frequent hashes, and joins the positions to drop back to their documents. Documents
without such a line are never rebuilt. The threshold is one count at every size: a line that goes from a part of the corpus goes from the whole.

Defined results: a null text stays null, an empty one empty; blank lines are neither counted nor dropped; a document whose
lines all go has the empty text; rows with one doc_id are one document in the counts, and each row is cleaned on its
own; null doc_ids count as one document; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

SHARE, LEAST_DOCS = 0.0, 10


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \\t\\r\\f]+", " ")))


def _hashes(text: Column) -> Column:
    """The hash of each line, null for blank ones."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(normal(x) != "", F.xxhash64(normal(x))))


def frequent_lines(docs: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(line_hash, docs) of the lines over the threshold."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"), F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line_hash")).filter("line_hash IS NOT NULL")
    total = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc")).agg(F.count_distinct("doc").alias("total"))
    counted = lines.distinct().groupBy("line_hash").agg(F.count("*").alias("docs")).filter(F.col("docs") > least_docs)
    return counted.crossJoin(F.broadcast(total)).filter(F.col("docs") > F.col("total") * F.lit(share)).select("line_hash", "docs")


def dedup_lines(docs: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the frequent lines cut out of text, and dropped_lines, the number of them."""
    count = free_name(docs, "dropped_lines")
    hot = written(frequent_lines(docs.select("doc_id", "text"), share, least_docs), "lines")
    # A row is known by its text's hash: rows of one text lose the same lines.
    key, other, cuts = (free_name(docs, c) for c in ("text_key", "seamark_key", "seamark_drop"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    at = docs.select(F.xxhash64("text").alias("k"), F.posexplode(_hashes(F.col("text"))).alias("pos", "line_hash")).filter("line_hash IS NOT NULL")
    drop = at.join(hot, "line_hash").groupBy("k").agg(F.collect_set("pos").alias("drop_at"))
    drop = drop.select(F.col("k").alias(other), F.col("drop_at").alias(cuts))
    joined = keyed.join(drop, F.col(key) == F.col(other), "left")
    # The positions that stay are a set difference, linear in the lines; the lines are bound once, in an array of one struct.
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cuts))
    cut = F.transform(F.array(F.struct(lines.alias("x"), stay.alias("at"))), lambda s: F.array_join(F.transform(s["at"], lambda i: F.get(s["x"], i)), "\n"))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.get(cut, F.lit(0)))
    dropped = F.coalesce(F.size(cuts), F.lit(0))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), dropped.alias(count))


ORACLE = f"""
WITH exploded AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, line, pos, lower(trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g'), ' ')) AS norm FROM exploded
), hot AS (
  SELECT norm FROM lines WHERE norm <> '' GROUP BY norm
  HAVING count(DISTINCT doc_id) > {LEAST_DOCS} AND count(DISTINCT doc_id) > (SELECT count(DISTINCT doc_id) FROM documents) * {SHARE}
), marked AS (
  SELECT doc_id, line, pos, norm IN (SELECT norm FROM hot) AS drop FROM lines
), again AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '') AS text, count(*) FILTER (drop) AS dropped_lines
  FROM marked GROUP BY doc_id
)
SELECT doc_id, text, CAST(dropped_lines AS INTEGER) AS dropped_lines FROM again
"""
