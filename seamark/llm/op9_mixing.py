"""Mixing sources to target weights by iterative proportional fitting.

Token sums by cell (source x language x topic) are raked until their marginals meet the targets of the three dimensions. Each cell's
documents are then sampled with one probability, calibrated so that the expected tokens are the budget spread by the raked weights;
a cell that would need more than all of its documents gives them all, and the rest is spread over the other cells.

Raking has two forms with one arithmetic, chosen by the measured number of cells: up to `driver_cells` combinations in use are raked as arrays (100 bytes a
cell), more are raked as a table, each step an aggregate over a dimension and a join, with the weights written between
rounds. No number of cells is refused and none is dropped. Sampling compares a hash of doc_id with the
probability of its cell, joined by a hash join, so it is one pass, the same on every run. Cells are counted, and raked, as the query is built.

Targets: a share for each named value; values that are present but not named share what the named ones leave, or `rest` if those leave less, by the power
`temper` of their tokens; named values without documents are left out, and all shares are scaled to sum to 1. A budget of 1 or more therefore keeps every document with tokens.
The topic is that of the text's form, as the corpus has no subject labels (see TOPICS); any other expression can be given as `topic`.

Defined results: a null source or language is the value '(none)', which is unnamed unless the targets name it; a null or empty text has no tokens and
is never sampled; a null doc_id hashes as an empty string; rows with one doc_id are kept or left together if they lie in one cell; other columns pass
through whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, written

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Shares by dimension; values that aren't named share what is left."""

    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.18, "fr": 0.15, "es": 0.12})
    topic: dict[str, float] = field(default_factory=lambda: {"legal": 0.04, "contact": 0.06, "tabular": 0.02, "numeric": 0.06, "prose": 0.82})
    source: dict[str, float] = field(default_factory=dict)
    #: Unnamed values share the rest by this power of their tokens: 1 as they are, 0 alike.
    temper: float = 0.5
    #: What the unnamed values of a dimension share at least, where there are any: the named ones are scaled to what is left.
    rest: float = 0.05
    #: Share of the corpus's tokens that is sampled.
    budget: float = 0.5
    rounds: int = 50
    tolerance: float = 1e-9
    #: More cells than these are raked as a table.
    driver_cells: int = 200_000

    def of(self, dimension: str) -> dict[str, float]:
        return getattr(self, dimension)


def topic_of(text: Column) -> Column:
    """The first form that fits: legal lines, contact data, tables, long numbers, prose. Plain searches come before the regular expressions."""
    legal = text.contains("Licensed") | text.contains("licensed") | text.contains("License") | text.contains("rights reserved")
    contact = text.contains("@") & text.rlike("[A-Za-z0-9]@[A-Za-z0-9]")
    out = F.when(legal, "legal").when(contact, "contact").when(text.contains(" | "), "tabular").when(text.rlike("[0-9]{6}"), "numeric")
    return F.coalesce(out, F.lit("prose"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def shares(named: dict[str, float], tokens: dict[str, float], temper: float, rest: float) -> dict[str, float]:
    """The target share of each value present; they sum to 1."""
    out = {v: named[v] for v in tokens if v in named and tokens[v] > 0}
    others = {v: t**temper for v, t in tokens.items() if v not in named and t > 0}
    if others:
        left = max(0.0, 1 - sum(named.values()))
        if left < rest:
            out, left = {v: x * (1 - rest) for v, x in out.items()}, rest
        everything = sum(others.values())
        out |= {v: left * x / everything for v, x in others.items()}
    everything = sum(out.values())
    return {v: x / everything for v, x in out.items()} if everything else {}


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Weights (summing to 1) of cells with these tokens, whose sums over each dimension's values meet the targets."""
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        off = 0.0
        for member, target in zip(members, targets):
            now = np.bincount(member, w, len(target))
            off = max(off, float(np.abs(now - target).max(initial=0)))
            w = w * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[member]
        if off <= tolerance:
            break
    return w / max(w.sum(), 1e-300)


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * weight / tokens), with the scale at which the expected tokens are the budget (or all that the weights reach)."""
    need = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    order = np.argsort(-need, kind="stable")
    t, w, n = tokens[order], weights[order], need[order]
    full = np.cumsum(t) - t  # tokens of the cells before, all taken
    left = np.cumsum(w[::-1])[::-1]
    scale = np.divide(budget - full, left, out=np.full(len(t), np.inf), where=left > 0)
    with np.errstate(invalid="ignore"):
        fits = np.flatnonzero((scale * n <= 1) & (budget >= full))
        s = scale[fits[0]] if len(fits) and budget < tokens.sum() else np.inf
        return np.where(need > 0, np.minimum(1.0, np.where(need > 0, s, 0) * need), 0.0)


def cell_probabilities(cells: list[tuple], targets: Targets) -> list[tuple]:
    """(source, lang, topic, tokens) to the same with weight and probability."""
    if not cells:
        return []
    cells = sorted(cells, key=lambda c: c[:3])
    tokens = np.array([c[3] for c in cells], float)
    members, goals = [], []
    for k, dimension in enumerate(DIMENSIONS):
        values = sorted({c[k] for c in cells})
        at = {v: i for i, v in enumerate(values)}
        member = np.array([at[c[k]] for c in cells])
        sums = np.bincount(member, tokens, len(values))
        share = shares(targets.of(dimension), dict(zip(values, sums.tolist())), targets.temper, targets.rest)
        members.append(member)
        goals.append(np.array([share.get(v, 0.0) for v in values]))
    w = rake(tokens, members, goals, targets.rounds, targets.tolerance)
    p = probabilities(tokens, w, targets.budget * tokens.sum())
    return [(*c[:3], float(c[3]), float(a), float(b)) for c, a, b in zip(cells, w, p)]


def _goals(cells: DataFrame, dimension: str, targets: Targets) -> DataFrame:
    """(dimension, goal): shares() as a table, for dimensions with any number of values."""
    named = targets.of(dimension)
    given = cells.sparkSession.createDataFrame(list(named.items()) or [], f"`{dimension}` string, given double")
    by = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).filter("t > 0").join(F.broadcast(given), dimension, "left")
    part = F.when(F.col("given").isNull(), F.pow("t", F.lit(targets.temper)))
    whole = by.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("others"))
    left = max(0.0, 1 - sum(named.values()))
    low = left < targets.rest
    of_named = F.col("given") * F.when((F.col("others") > 0) & F.lit(low), 1 - targets.rest).otherwise(1.0)
    raw = by.crossJoin(F.broadcast(whole)).select(dimension, F.coalesce(of_named, F.lit(targets.rest if low else left) * part / F.col("others")).alias("g"))
    return written(raw.crossJoin(F.broadcast(raw.agg(F.sum("g").alias("everything")))).select(dimension, F.when(F.col("everything") > 0, F.col("g") / F.col("everything")).otherwise(0.0).alias("goal")), "goals")


def rake_table(cells: DataFrame, targets: Targets) -> DataFrame:
    """cells(source, lang, topic, tokens) with weight and probability, by aggregates and joins; only sums reach the driver."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {d: _goals(cells, d, targets) for d in DIMENSIONS}
    now = written(cells.withColumn("weight", F.col("tokens") / F.lit(max(total, 1e-300))), "cells")
    for _ in range(targets.rounds):
        off, after = [], now
        for d in DIMENSIONS:
            sums = after.groupBy(d).agg(F.sum("weight").alias("sum")).join(goals[d], d, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
            off.append(sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] or 0.0)
            factor = sums.select(d, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            step = written(after.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "cells")
            forget(after)
            after = step
        now = after
        if max(off) <= targets.tolerance:
            break
    whole = float(now.agg(F.sum("weight")).first()[0] or 0) or 1.0
    now = now.withColumn("weight", F.col("weight") / F.lit(whole))
    need = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    budget, scale = targets.budget * total, 0.0
    while budget < total:  # each pass takes the cells that the scale fills out of the sharing; it only grows
        full, left = now.agg(F.sum(F.when(need * scale >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(need * scale >= 1, 0.0).otherwise(F.col("weight")))).first()
        after = (budget - float(full or 0)) / left if left else float("inf")
        if after <= scale * (1 + 1e-12):
            break
        scale = after
        if scale == float("inf"):
            break
    p = F.least(F.lit(1.0), need * F.lit(scale)) if 0 < budget < total and scale < float("inf") else F.lit(1.0 if budget > 0 else 0.0)
    return now.select(*DIMENSIONS, "tokens", "weight", F.when(need > 0, p).otherwise(0.0).alias("probability"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) by the key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cell_table(sums: DataFrame, targets: Targets) -> DataFrame:
    """(source, lang, topic, weight, probability) of cells(source, lang, topic, tokens)."""
    head = sums.limit(targets.driver_cells + 1).collect()
    if len(head) > targets.driver_cells:
        return rake_table(written(sums, "cells"), targets).select(*DIMENSIONS, "weight", "probability")
    return sums.sparkSession.createDataFrame([(*c[:3], *c[4:]) for c in cell_probabilities([tuple(r) for r in head], targets)], "source string, lang string, topic string, weight double, probability double")


def mix_sources(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """The sampled documents with topic, tokens, weight (of the cell) and probability."""
    targets = targets or Targets()
    names = {c: free_name(docs, c) for c in ("topic", "tokens", "weight", "probability")}
    mine, theirs = ([free_name(docs, f"{side}_{c}") for c in DIMENSIONS] for side in ("doc", "cell"))
    given = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in ("source", "lang")] + [topic_of(F.col("text")) if topic is None else F.coalesce(topic, F.lit("(none)"))]
    sums = docs.select(*(c.alias(d) for c, d in zip(given, DIMENSIONS)), tokens_of(F.col("text")).alias("n")).groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens"))
    known = cell_table(sums, targets).select(*(F.col(c).alias(n) for c, n in zip(DIMENSIONS, theirs)), F.col("weight").alias(names["weight"]), F.col("probability").alias(names["probability"]))
    keyed = docs.select(*(docs[f"`{c}`"] for c in docs.columns), tokens_of(F.col("text")).alias(names["tokens"]), *(c.alias(n) for c, n in zip(given, mine)))
    same = [F.col(a) == F.col(b) for a, b in zip(mine, theirs)]
    kept = keyed.join(known, same).filter((uniform(F.col("doc_id")) < F.col(names["probability"])) & (F.col(names["tokens"]) > 0))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(mine[2]).alias(names["topic"]), names["tokens"], names["weight"], names["probability"])
