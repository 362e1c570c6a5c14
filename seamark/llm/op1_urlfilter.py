"""URL filters as a sort-merge range join.

A URL's canonical key is its reversed host with a comma after each label, then path and query: `com,example,www,/a?b`. A rule for a domain (with its
subdomains), a host or a path prefix is a prefix of keys, that is an interval of the sorted keys; intervals of rules are nested or disjoint.

URLs and rules are cut at the same split points (quantiles of a sample of keys), a rule going to every part that its interval meets, and each part is
sorted on the JVM. One sweep over it pushes rules as they begin, pops those that ended, and gives every URL the rule on top, the most
specific one. Neither side is broadcast; a host with most of the URLs is cut by path, and one URL repeated many times by page_id. Each part is a task of its own. The split
points are drawn as the query is built: a count and a sample of a size by the number of parts.

Defined results: a URL that is null, or without `scheme://host`, has a null key and no rule; host names compare without case, user, port, or
final dot, and fragments don't count; among rules of one key `block` wins, then the smallest rule_id; rules that are null or have an empty prefix are left
out; repeated URLs each get a row, null page_ids too (an id that isn't a whole number counts as null); other columns aren't read. Without rules every URL is allowed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: (rule_id, action, kind, pattern); kind: domain, host, or prefix (host and path).
RULES = (
    (1, "block", "domain", "spam-farm.example.org"), (2, "block", "domain", "cheap-pills.example.com"), (3, "allow", "prefix", "www.cheap-pills.example.com/en/4"),
    (4, "allow", "domain", "example.net"), (5, "block", "prefix", "m.ththth.example.net/en/"), (6, "allow", "prefix", "m.ththth.example.net/en/25"), (7, "block", "domain", "ads-track.example.com"),
    (8, "block", "host", "example.com"), (9, "allow", "domain", "org"), (10, "block", "domain", "example.org"), (11, "allow", "domain", "ththwh.example.org"), (12, "block", "prefix", "www.ththwh.example.org/de/"), (13, "block", "domain", "Spam-Farm.example.org"),
)
SAMPLE_PER_PART = 200


def reversed_host(host: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    return F.when(clean != "", F.concat(F.array_join(F.reverse(F.split(clean, "[.]")), ","), F.lit(",")))


def canonical_key(url: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(reversed_host(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def rule_keys(rules: DataFrame) -> DataFrame:
    """(rule_id, action, key) from rule_id, action, kind, pattern."""
    host, path = F.regexp_extract("pattern", "^([^/]*)", 1), F.regexp_extract("pattern", "^[^/]*(/.*)?$", 1)
    key = F.when(F.col("kind") == "domain", reversed_host(host)).when(F.col("kind") == "host", F.concat(reversed_host(host), F.lit("/"))).otherwise(F.concat(reversed_host(host), F.when(path == "", F.lit("/")).otherwise(path)))
    return rules.select(whole("rule_id").alias("rule_id"), F.col("action").cast("string"), key.alias("key")).filter("rule_id IS NOT NULL AND action IS NOT NULL AND key IS NOT NULL")


def _parts_of(splits: list[tuple[str, int]]):
    """Arrow batches (kind, key, id, action) with the part of each row; a rule is repeated for each part that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            take, part = [], []
            for n, (kind, key, i) in enumerate(zip(kinds, keys, ids)):
                if kind:
                    take.append(n)
                    part.append(bisect_right(splits, (key, -1 if i is None else i)))
                else:
                    for p in range(bisect_right(splits, (key, -2)), bisect_left(splits, (key + "\U0010ffff", 0)) + 1):
                        take.append(n)
                        part.append(p)
            rows = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *rows.columns], ["part", "kind", "key", "id", "action"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, kind, key, id, action): rules have kind 0 and come before the URLs of their key."""
    part_now, stack = None, []  # stack: (key, rule_id, action) of the rules that the key at hand lies in
    for b in batches:
        out = []
        for part, kind, key, i, action in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "key", "id", "action"))):
            if part != part_now:
                part_now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, i, action))
            else:
                top = stack[-1] if stack else (None, None, "allow")
                out.append((i, key, top[2], top[1], len(stack)))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()))], ["page_id", "key", "verdict", "rule_id", "rules"])


def filter_urls(pages: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, key, verdict, rule_id, rules): the most specific rule of each URL, and how many rules it lies in."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.lit(1).alias("kind"), canonical_key(F.col("url").cast("string")).alias("key"), whole("page_id").alias("id"), F.lit(None).cast("string").alias("action"))
    known = urls.filter("key IS NOT NULL")
    # The sample that Spark's own range partitioning would draw: of a size by the number of parts, not of URLs.
    shares = known.agg(F.count("*").alias("n")).first()["n"]
    wanted = parts * SAMPLE_PER_PART
    drawn = sorted((r[0], -1 if r[1] is None else r[1]) for r in known.select("key", "id").sample(min(1.0, wanted / max(1, shares)), seed=7).collect())
    splits = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    starts = rule_keys(rules).select(F.lit(0).alias("kind"), "key", F.col("rule_id").alias("id"), "action")
    cut = known.unionByName(starts).mapInArrow(_parts_of(splits), "part int, kind int, key string, id long, action string")
    # Of rules with one key, the one that wins comes last, on top.
    order = [F.col("part"), F.col("key"), F.col("kind"), F.when(F.col("kind") == 0, F.when(F.col("action") == "block", 1).otherwise(0)), F.when(F.col("kind") == 0, -F.col("id")).otherwise(F.col("id"))]
    swept = cut.repartitionById(parts, "part").sortWithinPartitions(*order).mapInArrow(_sweep, "page_id long, key string, verdict string, rule_id long, rules int")
    none = urls.filter("key IS NULL").select(F.col("id").alias("page_id"), "key", F.lit("allow").alias("verdict"), F.lit(None).cast("long").alias("rule_id"), F.lit(0).alias("rules"))
    return swept.unionByName(none)


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_id long, action string, kind string, pattern string")


_VALUES = ", ".join(f"({i}, '{a}', '{k}', '{p.lower()}')" for i, a, k, p in RULES)
_REVERSED = "array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(regexp_replace(lower({}), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''), '.')), ',') || ','"
_HOST, _PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)", r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
ORACLE = f"""
WITH rules AS (
  SELECT rule_id, action, {_REVERSED.format("string_split(pattern, '/')[1]")} || CASE WHEN kind = 'domain' THEN '' WHEN kind = 'host' OR strpos(pattern, '/') = 0 THEN '/' ELSE substr(pattern, strpos(pattern, '/')) END AS rule_key
  FROM (VALUES {_VALUES}) AS v(rule_id, action, kind, pattern)
), keyed AS (
  SELECT page_id, CASE WHEN {_HOST} <> '' THEN {_REVERSED.format(_HOST)} || CASE WHEN starts_with({_PATH}, '/') THEN '' ELSE '/' END || {_PATH} END AS key FROM pages
), hit AS (
  SELECT page_id, key, rule_id, action, count(*) OVER (PARTITION BY page_id) AS rules,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_key) DESC, action DESC, rule_id) AS n
  FROM keyed JOIN rules ON starts_with(key, rule_key)
)
SELECT k.page_id, k.key, coalesce(h.action, 'allow') AS verdict, CAST(h.rule_id AS BIGINT) AS rule_id, CAST(coalesce(h.rules, 0) AS INTEGER) AS rules
FROM keyed k LEFT JOIN hit h ON h.page_id = k.page_id AND h.n = 1
"""
