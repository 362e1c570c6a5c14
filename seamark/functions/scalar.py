"""Numbers: vectors, trigrams, costs, rates, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRICES


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def trigrams(term: Column) -> Column:
    """Ordered three-character windows of the term with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(term), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all of the distinct trigrams."""
    x, y = F.array_distinct(trigrams(a)), F.array_distinct(trigrams(b))
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def word_similarity(a: Column, b: Column) -> Column:
    """The best shared / (a's trigrams + extent - shared) over the runs of b's ordered trigrams (a run's distinct ones count)."""
    x, y = F.array_distinct(trigrams(a)), trigrams(b)
    n = F.size(y)

    def run(i: Column, k: Column) -> Column:
        part = F.array_distinct(F.slice(y, i, k))
        both = F.size(F.array_intersect(x, part))
        return both / (F.size(x) + F.size(part) - both)

    best = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: run(i, k))))
    return F.array_max(best)


def edit_cap(term: Column) -> Column:
    return F.when(F.length(term) >= 8, 2).otherwise(1)


def prices(spark) -> DataFrame:
    return spark.createDataFrame([(m, float(i), float(o)) for m, (i, o) in PRICES.items()], "model string, price_in double, price_out double")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars, rounded to six digits in each part and in sum; an unknown model is free."""
    part = lambda n, p: F.round(F.coalesce(n, F.lit(0)) * F.coalesce(p, F.lit(0.0)) / 1e6, 6)
    return F.round(part(tokens_in, price_in) + part(tokens_out, price_out), 6)


def rrf(semantic_rank: Column, keyword_rank: Column, keyword_score: Column, semantic_weight: float, keyword_weight: float, offset: int) -> Column:
    """Weighted reciprocal ranks, and a bonus as of rank 0 where the keyword score is at least a half."""
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(offset) + r), F.lit(0.0))
    return part(semantic_weight, semantic_rank) + part(keyword_weight, keyword_rank) + F.when(keyword_score >= 0.5, keyword_weight / offset).otherwise(0.0)


def pct_delta(recent: Column, prior: Column) -> Column:
    return F.when(prior <= 0, F.when(recent > 0, F.lit(None).cast("double")).otherwise(0.0)).otherwise(F.round((recent - prior) / prior * 100, 1))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def entry_status(excluded: Column, last_indexed: Column, updated: Column) -> Column:
    return F.when(excluded, "excluded").when(last_indexed.isNull(), "not-indexed").when(F.date_trunc("second", updated) > F.date_trunc("second", last_indexed), "stale").otherwise("indexed")


def budget(spent: Column, cap: float, burn: Column) -> Column:
    """(ratio, eta_days); the eta is the cap over the average spend of a day."""
    ratio = F.least(F.lit(1.0), F.round(spent / cap, 4)) if cap > 0 else F.lit(0.0)
    eta = F.when(burn > 0, F.round(F.lit(cap) / burn, 1)) if cap > 0 else F.lit(None).cast("double")
    return F.struct(ratio.alias("ratio"), eta.alias("eta_days"))


def trending_window(days: int) -> int:
    return min(14, max(3, days // 2))


def allowed_range(days: int) -> int:
    return days if days in (7, 30, 90) else 30


def seconds_to_midnight(at: Column) -> Column:
    """Seconds until the next day begins, in UTC sessions."""
    return F.unix_timestamp(F.date_trunc("day", at) + F.make_dt_interval(days=F.lit(1))) - F.unix_timestamp(at)


def slot(at: Column, window: int) -> Column:
    """The number of the window that a time lies in."""
    return F.floor(F.unix_timestamp(at) / window)
