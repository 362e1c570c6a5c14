"""Nearest chunks by cosine similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEAST_FETCH, OVER_FETCH
from ..functions.scalar import cosine
from .lexical import best_chunks


def nearest(vectors: DataFrame, query: DataFrame, fetch: int, site_id: int | None = None, sections: list[int] | None = None) -> DataFrame:
    """The `fetch` chunks nearest to the one vector in query(q), after the filters: every task keeps its best, one merges them."""
    if site_id is not None:
        vectors = vectors.filter(F.col("site_id") == site_id)
    if sections is not None:
        vectors = vectors.filter(F.col("section_id").isin(sections))
    near = vectors.crossJoin(F.broadcast(query)).withColumn("similarity", cosine(F.col("vector"), F.col("q"))).filter("similarity IS NOT NULL")
    return near.select("element_id", "site_id", "section_id", "chunk", "similarity").orderBy(F.desc("similarity"), "element_id", "site_id", "chunk").limit(fetch)


def semantic(vectors: DataFrame, query: DataFrame, limit: int, site_id: int | None = None, sections: list[int] | None = None) -> DataFrame:
    """The best chunk of each entry among max(20, 3 * limit) nearest chunks, the best `limit` of them, with rank."""
    return best_chunks(nearest(vectors, query, max(LEAST_FETCH, OVER_FETCH * limit), site_id, sections), limit, "similarity")
