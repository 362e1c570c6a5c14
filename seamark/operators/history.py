"""Analytics of the search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def days_before(now: str, days: int) -> Column:
    return F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))


def within(log: DataFrame, now: str, days: int | None = None, site_id: int | None = None, kind: str | None = None, until_days: int | None = None, named: bool = False, zero: bool = False, errors: bool = False) -> DataFrame:
    """The rows of a window and of the given site and type; named: with a query, zero: without results. Filters that are None are left out."""
    if days is not None and days > 0:
        log = log.filter(F.col("created") >= days_before(now, days))
    if until_days is not None:
        log = log.filter(F.col("created") < days_before(now, until_days))
    if site_id is not None:
        log = log.filter(F.col("site_id") == site_id)
    if kind is not None:
        log = log.filter(F.col("type") == kind)
    if named:
        log = log.filter("query <> ''")
    if zero:
        log = log.filter("results = 0")
    if errors:
        log = log.filter("has_error")
    return log


def stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("searches"), F.coalesce(F.sum("embedding_tokens"), F.lit(0)).alias("embedding_tokens"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("answer_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0)).cast("double"), 6).alias("cost"), F.round(F.avg("duration_ms")).cast("int").alias("mean_ms"), F.count_if("has_error").alias("errors"),
    )


def query_counts(log: DataFrame) -> DataFrame:
    """(key, query, hits, mean_results, last): queries grouped without case and outer blanks."""
    key = F.lower(F.trim("query"))
    return log.groupBy(key.alias("key")).agg(F.min("query").alias("query"), F.count("*").alias("hits"), F.round(F.avg("results"), 6).alias("mean_results"), F.max("created").alias("last"))


def top_queries(log: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return query_counts(log).orderBy(F.desc("hits"), "key").offset(offset).limit(limit)


def page(log: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """A page of the log, newest first, with total and pages in each row."""
    size = max(1, min(100, size))
    total = log.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("int"))
    rows = log.orderBy(F.desc("created"), F.desc("id")).offset((max(1, number) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))


def shares(log: DataFrame, limit: int) -> DataFrame:
    """The top queries with their share of all named searches in percent."""
    total = log.agg(F.count("*").alias("total"))
    return top_queries(log, limit).crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("hits") / F.col("total") * 100, 1))


def trending(log: DataFrame, now: str, window: int, limit: int) -> DataFrame:
    """Queries that rose over the window before: one pass, counts by condition, a single shuffle on the key."""
    recent = F.col("created") >= days_before(now, window)
    both = within(log, now, window * 2, named=True).groupBy(F.lower(F.trim("query")).alias("key")).agg(
        F.coalesce(F.min(F.when(recent, F.col("query"))), F.min("query")).alias("query"), F.count_if(recent).alias("recent"), F.count_if(~recent).alias("prior"),
    )
    risen = both.withColumn("delta", F.col("recent") - F.col("prior")).filter("delta > 0")
    risen = risen.withColumn("growth_pct", F.when(F.col("prior") > 0, F.round(F.col("delta") / F.col("prior") * 100, 1)))
    return risen.orderBy(F.desc("delta"), "key").limit(limit)


def daily(log: DataFrame, now: str, days: int) -> DataFrame:
    """(day, searches, cost, errors) for each of days + 1 days, with zeros in gaps; the first day is cut off by the time of now."""
    buckets = within(log, now, days).groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("searches"), F.sum("cost").cast("double").alias("cost"), F.count_if("has_error").alias("errors"))
    last = F.to_date(F.lit(now))
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days), last)).alias("day"))
    return F.broadcast(spine).join(buckets, "day", "left").select("day", F.coalesce("searches", F.lit(0)).alias("searches"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"), F.coalesce("errors", F.lit(0)).alias("errors"))


def share_of(log: DataFrame, part: Column, name: str) -> DataFrame:
    """The share of rows for which part holds, null without rows."""
    return log.agg(scalar.rate(F.count_if(part), F.count("*")).alias(name))


def recent_errors(log: DataFrame, limit: int) -> DataFrame:
    return log.filter("has_error").select("id", "type", "created", "query", "error").orderBy(F.desc("created"), "id").limit(max(1, min(50, limit)))


def available_sites(log: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites in the log by name without case; unknown ones as `Site #id`."""
    seen = log.filter("site_id IS NOT NULL").select("site_id").distinct()
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("handle"), F.lit("")), F.concat(F.lit("Site #"), F.col("site_id").cast("string")))
    return seen.join(F.broadcast(sites), "site_id", "left").select("site_id", name.alias("name"), "handle").orderBy(F.lower("name"), "site_id")


def append(log: DataFrame, path: str) -> None:
    """The log's sink: derived columns are added, rows appended."""
    log.withColumn("has_error", F.col("error").isNotNull()).write.mode("append").parquet(path)
