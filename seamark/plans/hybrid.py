"""Hybrid search: semantic and keyword ranks fused, boosted, hydrated, formatted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANK_OFFSET, Settings
from ..functions import scalar, text


def _last(df: DataFrame, *columns: str) -> DataFrame:
    """Of an element's rows (one a site) the one with the worst rank: later rows overwrite earlier ones."""
    w = Window.partitionBy("element_id").orderBy(F.desc("rank"))
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").select("element_id", *columns)


def fuse(semantic: DataFrame, keyword: DataFrame, s: Settings) -> DataFrame:
    """(element_id, scores, ranks, chunk keys, score): full outer on element_id; weak semantic-only rows go."""
    a = _last(semantic, F.col("site_id").alias("s_site"), F.col("chunk").alias("s_chunk"), F.col("similarity").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    b = _last(keyword, F.col("site_id").alias("k_site"), F.col("chunk").alias("k_chunk"), F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    both = a.join(b, "element_id", "full_outer").filter(~(F.col("keyword_rank").isNull() & (F.col("semantic_score") < s.least_semantic)))
    scored = both.withColumn("score", scalar.rrf(F.col("semantic_rank"), F.col("keyword_rank"), F.col("keyword_score"), s.semantic_weight, s.keyword_weight, RANK_OFFSET))
    # Where a side found nothing its rank is null, but its score is 0.
    return scored.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("semantic_score", "keyword_score")})


def add_boosts(fused: DataFrame, boosts: DataFrame) -> DataFrame:
    """Adds each boost; an element with nothing else gets ranks and scores of 0."""
    out = fused.join(boosts, "element_id", "full_outer")
    only = F.col("score").isNull()
    for c in ("semantic_rank", "keyword_rank", "semantic_score", "keyword_score"):
        out = out.withColumn(c, F.when(only, 0).otherwise(F.col(c)))
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).drop("boost")


def order() -> list:
    """Score first; ties as a stable sort would leave them."""
    return [F.desc(F.round("score", 12)), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), F.asc("element_id")]


def with_bodies(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(element_id, site_id, chunk, ...), a page of results, with title and body of the chunk."""
    keys = ["element_id", "site_id", "chunk"]
    return F.broadcast(ranked).join(chunks.select(*keys, "title", "body"), keys)


def hydrate(ranked: DataFrame, entries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The first `limit` elements that are there and have a URL, with smart_rank, title, url, and the winning chunk's text.

    Texts are fetched last, for survivors only.
    """
    live = entries.filter("url IS NOT NULL AND status = 'enabled'").select("element_id", "title", "url").join(ranked.select("element_id"), "element_id", "left_semi").dropDuplicates(["element_id"])
    top = ranked.join(live, "element_id").orderBy(*order()).limit(limit)
    top = top.withColumn("smart_rank", F.row_number().over(Window.orderBy(*order())))
    keyed = top.withColumn("c", F.coalesce("s_chunk", "k_chunk")).withColumn("t", F.coalesce("s_site", "k_site"))
    bodies = chunks.select(F.col("element_id").alias("e"), F.col("site_id").alias("t2"), F.col("chunk").alias("c2"), "body")
    got = bodies.join(F.broadcast(keyed), (F.col("e") == F.col("element_id")) & (F.col("t2") == F.col("t")) & (F.col("c2") == F.col("c")), "left_semi")
    return keyed.join(got, (F.col("e") == F.col("element_id")) & (F.col("c2") == F.col("c")), "left").withColumn("content", F.coalesce("body", F.lit(""))).drop("e", "t2", "c2", "body", "c", "t")


def formatted(results: DataFrame, length: int = Settings.excerpt) -> DataFrame:
    """What a caller sees: rounded scores, an excerpt, ranks."""
    return results.select(
        "element_id", "title", "url", F.round("score", 4).alias("score"), text.excerpt(F.col("content"), F.col("title"), length).alias("excerpt"),
        F.round("semantic_score", 4).alias("semantic_score"), F.round("keyword_score", 4).alias("keyword_score"), "semantic_rank", "keyword_rank", "smart_rank",
    )
