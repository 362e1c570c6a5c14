"""Figures of the dashboard: period deltas, burn and budget, health, advice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def half_windows(series: DataFrame, days: int) -> DataFrame:
    """Totals of a daily series and the change of its later half (of ceil(days / 2) rows) over the rest."""
    half = math.ceil(days / 2)
    # A series has a row a day, 366 at most: one partition is what it takes.
    n = series.withColumn("back", F.row_number().over(Window.orderBy(F.desc("day"))))
    part = lambda c, recent: F.coalesce(F.sum(F.when(F.col("back") <= half if recent else F.col("back") > half, F.col(c))), F.lit(0))
    t = n.agg(*(f.alias(x) for f, x in ((F.sum("searches"), "searches"), (F.sum("cost"), "c"), (F.sum("errors"), "errors"), (part("searches", True), "rs"), (part("searches", False), "ps"), (part("cost", True), "rc"), (part("cost", False), "pc"))))
    return t.select(
        F.lit(days).alias("range_days"), F.lit(half).alias("half_days"), "searches", scalar.pct_delta(F.col("rs"), F.col("ps")).alias("searches_delta"), F.round("c", 6).alias("cost"),
        scalar.pct_delta(F.round("rc", 6), F.round("pc", 6)).alias("cost_delta"), "errors", F.coalesce(scalar.rate(F.col("errors"), F.col("searches")), F.lit(0.0)).alias("error_rate"),
    )


def traffic(series: DataFrame) -> DataFrame:
    """(burn, days_with_data, searches, errors, week) of a daily series in one pass: burn is the mean cost of the last seven rows, always by 7; week their searches."""
    n = series.withColumn("back", F.row_number().over(Window.orderBy(F.desc("day"))))
    last = F.col("back") <= 7
    return n.agg(
        F.round(F.coalesce(F.sum(F.when(last, F.col("cost"))), F.lit(0.0)) / 7.0, 6).alias("burn"), F.count_if(F.col("searches") > 0).alias("days_with_data"),
        F.sum("searches").alias("searches"), F.sum("errors").alias("errors"), F.sum(F.when(last, F.col("searches"))).alias("week"),
    )


def burn(series: DataFrame) -> DataFrame:
    return traffic(series).select("burn", "days_with_data")


def figures(log: DataFrame, since: Column, day: str) -> DataFrame:
    """(cache_hit_rate, zero_result_rate, spent) of a log in one pass: the rates since then, the answers' cost on the day."""
    recent = F.col("created") >= since
    n = F.count_if(recent)
    today = (F.col("type") == "aiAnswer") & (F.to_date("created") == F.lit(day).cast("date"))
    return log.agg(
        scalar.rate(F.count_if(recent & F.col("cached")), n).alias("cache_hit_rate"), scalar.rate(F.count_if(recent & (F.col("results") == 0)), n).alias("zero_result_rate"),
        F.round(F.coalesce(F.sum(F.when(today, F.col("cost"))), F.lit(0)).cast("double"), 6).alias("spent"),
    )


def budget(spent: DataFrame, burned: DataFrame, cap: float) -> DataFrame:
    """(spent, ratio, eta_days, shown_eta, state): the eta is shown if below 30 days and seven days have data."""
    return _budgeted(spent.crossJoin(F.broadcast(burned)), cap).select("spent", "ratio", "eta_days", "days_with_data", "shown_eta", "state")


def _budgeted(row: DataFrame, cap: float) -> DataFrame:
    out = row.withColumn("b", scalar.budget(F.col("spent"), cap, F.col("burn"))).select("*", "b.ratio", "b.eta_days").drop("b")
    shown = F.when((F.col("eta_days") < 30) & (F.col("days_with_data") >= 7), F.col("eta_days"))
    return out.withColumn("shown_eta", shown).withColumn("state", F.when(F.col("ratio") >= 0.9, "crit").when(F.col("ratio") >= 0.75, "warn").otherwise("ok"))


def daily_spend(log: DataFrame, cap: float) -> DataFrame:
    """Each answer's spend so far in its day, and whether the gate was open before it. Searches cost nothing here."""
    day = F.to_date("created")
    w = Window.partitionBy("day").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, -1)
    a = log.filter("type = 'aiAnswer'").select("id", day.alias("day"), "created", "cost")
    before = F.coalesce(F.sum("cost").over(w), F.lit(0)).cast("double")
    return a.withColumn("spent_before", F.round(before, 6)).withColumn("open", F.lit(cap) <= 0 if cap <= 0 else F.col("spent_before") < cap).select("id", "day", "spent_before", "open")


def sync_health(stats: DataFrame, now: str) -> DataFrame:
    """warn if nothing is indexed, or nothing in the last 72 hours."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("last_indexed")) / 3600
    return stats.select(F.lit("sync").alias("key"), F.when(F.col("last_indexed").isNull() | (age > 72), "warn").otherwise("ok").alias("state"))


def health(stats: DataFrame, budgeted: DataFrame, now: str, has_key: bool, connected: bool = True, pending: int = 0) -> DataFrame:
    spark = stats.sparkSession
    fixed = spark.createDataFrame([("api", "ok" if has_key and connected else "crit"), ("indexer", "ok")], "key string, state string")
    return fixed.unionByName(sync_health(stats, now)).unionByName(budgeted.select(F.lit("budget").alias("key"), "state"))


def advice(numbers: DataFrame, seen: DataFrame, coverage: DataFrame, cap: float, has_key: bool) -> DataFrame:
    """(level, about): what needs attention, from the one-row frames of figures(), traffic() and coverage_totals(). Each of those is made once; the rules are conditions on one row."""
    row = _budgeted(numbers.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(coverage.select("stale", "not_indexed", "total"))), cap)
    ratio, eta, total, some = F.col("ratio"), F.col("eta_days"), F.col("total"), F.col("total") > 0
    part = lambda c: F.col(c) / F.when(some, total)
    rules = [
        ("crit", "budget", ratio >= 0.9), ("warn", "budget", (ratio >= 0.75) & (ratio < 0.9)), ("info", "budget-eta", (ratio < 0.75) & (eta < 7) & (eta > 0)),
        ("warn", "stale", some & (part("stale") > 0.05)), ("info", "not-indexed", some & (part("not_indexed") > 0.1)),
        ("info", "cache", (F.col("cache_hit_rate") < 0.15) & (F.col("searches") > 50)), ("warn", "zero-results", F.col("zero_result_rate") > 0.4),
        ("info", "no-traffic", some & (F.col("week") == 0)), ("crit", "errors", some & (F.col("searches") > 100) & (F.col("errors") / F.when(F.col("searches") > 0, F.col("searches")) > 0.1)), ("crit", "no-key", F.lit(not has_key)),
    ]
    on = F.filter(F.array(*(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(about).alias("about"))) for level, about, cond in rules)), lambda x: x.isNotNull())
    return row.select(F.explode(on).alias("x")).select("x.*")


def usage(log: DataFrame) -> DataFrame:
    """(request, tokens, cost, cached) summed for each request of a user and day; cached if every row was."""
    return log.groupBy("user_id", F.to_date("created").alias("day")).agg(F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"), F.bool_and("cached").alias("cached"))
