"""The chunk index: incremental upsert, deletes, fingerprints, statistics, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..session import written

KEY = ["element_id", "site_id"]


def join_keys(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a.join(b) on KEY, where an entry without a site is one too: null keys meet."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in KEY})
    both = a.join(other, F.col(KEY[0]).eqNullSafe(F.col(f"_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"_{KEY[1]}")), how)
    if how in ("left_semi", "left_anti"):
        return both
    if how == "full_outer":
        both = both.withColumns({c: F.coalesce(c, f"_{c}") for c in KEY})
    return both.drop(*(f"_{c}" for c in KEY))


def eligible(entries: DataFrame) -> DataFrame:
    """Entries to index: enabled, with a URL, no drafts or revisions where the table tells."""
    for c in ("is_draft", "is_revision"):
        if c in entries.columns:
            entries = entries.filter(~F.coalesce(F.col(c), F.lit(False)))
    return entries.filter("status = 'enabled' AND url IS NOT NULL AND url <> ''")


def fingerprint(index: DataFrame) -> DataFrame:
    return index.groupBy(*KEY).agg(F.max("content_hash").alias("content_hash"), F.count("*").alias("chunks"))


def changes(entries: DataFrame, index: DataFrame) -> DataFrame:
    """entries (with chunk texts as array `chunks`) and what to do: 'touch' if hash and number of chunks are as stored, else 'embed'."""
    now = entries.withColumn("content_hash", F.sha2("text", 256)).withColumn("n", F.size("chunks"))
    old = fingerprint(index).select(*KEY, F.col("content_hash").alias("old_hash"), F.col("chunks").alias("old_n"))
    same = (F.col("content_hash") == F.col("old_hash")) & (F.col("n") == F.col("old_n"))
    return now.join(old, KEY, "left").withColumn("action", F.when(F.coalesce(same, F.lit(False)), "touch").otherwise("embed")).drop("old_hash", "old_n")


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with rows replacing those of the same (element_id, site_id, chunk)."""
    return index.join(rows.select(*KEY, "chunk"), [*KEY, "chunk"], "left_anti").unionByName(rows)


def delete_tails(index: DataFrame, totals: DataFrame) -> DataFrame:
    """Without chunks at or beyond an entry's new total(element_id, site_id, total)."""
    return index.join(totals, KEY, "left").filter(F.col("total").isNull() | (F.col("chunk") < F.col("total"))).drop("total")


def touch(index: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """indexed and section_id of the entries in keys(element_id, site_id, new_section)."""
    k = keys.withColumn("hit", F.lit(True))
    out = index.join(k, KEY, "left")
    hit = F.coalesce("hit", F.lit(False))
    return out.withColumn("indexed", F.when(hit, F.to_timestamp(F.lit(now))).otherwise(F.col("indexed"))).withColumn("section_id", F.when(hit, F.col("new_section")).otherwise(F.col("section_id"))).drop("hit", "new_section")


def delete(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys, KEY, "left_anti")


def orphans(index: DataFrame, active: DataFrame) -> DataFrame:
    """Indexed keys that no entry has, with their rows' number."""
    return index.join(active, KEY, "left_anti").groupBy(*KEY).agg(F.count("*").alias("rows"))


def decisions(index: DataFrame, entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """entries and indexed keys with what to do: 'delete' (disabled, excluded, vanished), 'keep' (no text), 'touch' (unchanged), 'embed'. One full outer join of fingerprints."""
    old = fingerprint(index).select(*KEY, F.col("content_hash").alias("old_hash"), F.col("chunks").alias("old_n"))
    gone = excluded.select(*KEY).distinct().withColumn("gone", F.lit(True))
    live = F.coalesce((F.col("status") == "enabled") & (F.col("url") != "") & F.col("gone").isNull(), F.lit(False))
    now = join_keys(entries, gone, "left").withColumn("live", live).withColumn("content_hash", F.when(F.col("live"), F.sha2("text", 256)))
    same = F.coalesce((F.col("content_hash") == F.col("old_hash")) & (F.size("chunks") == F.col("old_n")), F.lit(False))
    action = F.when(~F.coalesce("live", F.lit(False)), "delete").when(F.coalesce(F.trim("text"), F.lit("")) == "", "keep").when(same, "touch").otherwise("embed")
    both = join_keys(now, old, "full_outer").withColumn("action", action)
    return both.select(*KEY, "action", "section_id", "title", "content_hash", F.when(F.col("action") == "embed", F.col("chunks")).alias("chunks"))


def sync(index: DataFrame, entries: DataFrame, excluded: DataFrame, now: str) -> DataFrame:
    """The index after all entries were synced; entries have (element_id, site_id, section_id, title, url, status, text, chunks).

    Disabled, excluded and vanished entries go; entries without text keep what they have; unchanged ones are touched; the others' chunks
    replace the stored ones. The decisions are written once, so entries are read once and the index twice: for fingerprints and for what stays.
    """
    todo = written(decisions(index, entries, excluded), "decisions")
    embed = todo.filter("action = 'embed'")
    rows = embed.select(*KEY, "section_id", "title", "content_hash", F.size("chunks").alias("total"), F.posexplode("chunks").alias("chunk", "body"), F.to_timestamp(F.lit(now)).alias("indexed"))
    stay = todo.filter("action IN ('keep', 'touch')").select(*KEY, (F.col("action") == "touch").alias("hit"), F.col("section_id").alias("new_section"))
    same = join_keys(index, stay, "inner").withColumn("indexed", F.when(F.col("hit"), F.to_timestamp(F.lit(now))).otherwise(F.col("indexed"))).withColumn("section_id", F.when(F.col("hit"), F.col("new_section")).otherwise(F.col("section_id")))
    return same.select(*rows.columns).unionByName(rows)


def lookup(index: DataFrame, element_id: int, site_id: int) -> DataFrame:
    """The chunks of one entry, in order; both filters reach the scan."""
    return index.filter((F.col("element_id") == element_id) & (F.col("site_id") == site_id)).orderBy("chunk")


def delete_all(index: DataFrame) -> DataFrame:
    """Nothing, in the same columns."""
    return index.limit(0)


def exclude(excluded: DataFrame, keys: DataFrame) -> DataFrame:
    """excluded with keys added, each once."""
    return excluded.select(*KEY).unionByName(keys.select(*KEY)).distinct()


def include(excluded: DataFrame, keys: DataFrame) -> DataFrame:
    return excluded.join(keys.select(*KEY), KEY, "left_anti")


def are_excluded(keys: DataFrame, excluded: DataFrame) -> DataFrame:
    """keys with `excluded`."""
    x = excluded.select(*KEY).distinct().withColumn("excluded", F.lit(True))
    return keys.join(x, KEY, "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def exists(rows: DataFrame, name: str = "found") -> DataFrame:
    """Whether there is a row; one is read."""
    return rows.limit(1).agg((F.count("*") > 0).alias(name))


def stats(index: DataFrame, by_site: bool = False) -> DataFrame:
    aggs = [F.count_distinct("element_id").alias("elements"), F.count("*").alias("chunks"), F.max("indexed").alias("last_indexed")]
    return index.groupBy("site_id").agg(*aggs) if by_site else index.agg(*aggs)


def summary(index: DataFrame) -> DataFrame:
    return index.groupBy(*KEY).agg(F.count("*").alias("chunks"), F.max("indexed").alias("last_indexed"))


def statuses(entries: DataFrame, index: DataFrame, excluded: DataFrame) -> DataFrame:
    """(element_id, site_id, title, updated, chunks, last_indexed, status) of every eligible entry."""
    x = excluded.select(*KEY).distinct().withColumn("x", F.lit(True))
    out = eligible(entries).select(*KEY, "title", "updated").join(summary(index), KEY, "left").join(x, KEY, "left")
    status = scalar.entry_status(F.coalesce("x", F.lit(False)), F.col("last_indexed"), F.col("updated"))
    return out.withColumn("status", status).withColumn("chunks", F.coalesce("chunks", F.lit(0))).drop("x")


def counts_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("entries"))


def entry_page(rows: DataFrame, status: str | None, number: int, size: int = 25) -> DataFrame:
    """A page of the entries of one status, by id; total is counted after the filter, the counts by status before it."""
    kept = rows.filter(F.col("status") == status) if status else rows
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy(*KEY).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def coverage(rows: DataFrame) -> DataFrame:
    """(site_id, indexed, stale, not_indexed, total); excluded entries don't count."""
    s = F.col("status")
    return rows.filter(s != "excluded").groupBy("site_id").agg(F.count_if(s == "indexed").alias("indexed"), F.count_if(s == "stale").alias("stale"), F.count_if(s == "not-indexed").alias("not_indexed"), F.count("*").alias("total"))


def coverage_totals(by_site: DataFrame) -> DataFrame:
    t = by_site.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("indexed", "stale", "not_indexed")), F.count_if((F.col("indexed") == F.col("total")) & (F.col("total") > 0)).alias("full_sites"))
    total = F.col("indexed") + F.col("stale") + F.col("not_indexed")
    return t.withColumn("total", total).withColumn("pct", F.when(total > 0, F.round(F.col("indexed") / total * 100).cast("int")).otherwise(0))


def site_overview(sites: DataFrame, by_site: DataFrame, index: DataFrame) -> DataFrame:
    """Sites with coverage and index statistics, the best covered first."""
    j = sites.select("site_id", "name").join(by_site, "site_id", "left").join(stats(index, by_site=True), "site_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    out = j.select("site_id", "name", z("indexed").alias("indexed"), z("total").alias("total"), z("elements").alias("elements"), z("chunks").alias("chunks"), "last_indexed")
    return out.withColumn("pct", F.when(F.col("total") > 0, F.round(F.col("indexed") / F.col("total") * 100).cast("int")).otherwise(0)).orderBy(F.desc("pct"), F.desc("indexed"), F.lower("name"))


def inspection(chunks: DataFrame) -> DataFrame:
    """(element_id, site_id, chunks, tokens, largest): token estimates of an entry's chunks."""
    n = text.tokens(F.coalesce("body", F.lit("")))
    return chunks.groupBy(*KEY).agg(F.count("*").alias("chunks"), F.sum(n).alias("tokens"), F.max(n).alias("largest"))


def chunk_bars(chunks: DataFrame) -> DataFrame:
    """(element_id, site_id, chunk, tokens, bar): each chunk's tokens, and in percent of the entry's largest."""
    n = chunks.select(*KEY, "chunk", text.tokens(F.coalesce("body", F.lit(""))).alias("tokens"))
    most = F.max("tokens").over(Window.partitionBy(*KEY))
    return n.withColumn("bar", F.when(most > 0, F.round(F.col("tokens") * 100 / most).cast("int")).otherwise(0))
