"""Phrase rules that lift entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lexeme, positions


def valid_rules(rules: DataFrame) -> DataFrame:
    """(element_id, site_id, terms array<string>, weight) to rules with non-empty trimmed terms and a positive weight, and their label."""
    terms = F.filter(F.transform("terms", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return rules.withColumn("terms", terms).filter((F.size("terms") > 0) & (F.col("weight") > 0)).withColumn("label", F.array_join("terms", " + "))


def sync(stored: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """stored with the rules of the entries in keys replaced by the valid ones of new."""
    return stored.join(keys.select("element_id", "site_id").distinct(), ["element_id", "site_id"], "left_anti").unionByName(valid_rules(new))


def delete(stored: DataFrame, element_id: int, site_id: int | None = None) -> DataFrame:
    """stored without the rules of an element, on one site or on all."""
    gone = F.col("element_id") == element_id
    return stored.filter(~(gone if site_id is None else gone & (F.col("site_id") == site_id)))


def expanded(query: DataFrame, variants: DataFrame) -> DataFrame:
    """query(query) to (slots): at each position the token's lexeme and its variants, as query terms match them."""
    p = query.select(F.explode(positions(F.col("query"))).alias("p")).select("p.*")
    v = variants.groupBy("raw").agg(F.array_sort(F.collect_set("term")).alias("more"))
    other = F.trim(F.regexp_replace("raw", "[^\\p{L}\\p{N}.]+", ""), F.lit("."))
    own = F.when(F.col("word"), clean_lexeme(F.col("raw"))).otherwise(other)
    lexemes = F.filter(F.array_distinct(F.concat(F.array(own), F.when(F.col("word"), F.coalesce("more", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))), lambda x: x != "")
    s = p.join(v, "raw", "left").select("pos", lexemes.alias("lexemes"))
    return s.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lexemes"))), lambda x: x["lexemes"]).alias("slots"))


def phrase_matches(slots: Column, phrase: Column) -> Column:
    """The phrase's lexemes are at consecutive positions."""
    n, k = F.size(slots), F.size(phrase)
    fits = lambda i: F.forall(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.array_contains(F.element_at(slots, i + j), F.element_at(phrase, j + 1))), lambda x: x)
    return F.when((k > 0) & (n >= k), F.exists(F.sequence(F.lit(1), n - k + 1), fits)).otherwise(False)


def match(rules: DataFrame, slots: DataFrame, site_id: int | None = None) -> DataFrame:
    """(element_id, boost): the weights of the rules all of whose phrases match, summed."""
    if site_id is not None:
        rules = rules.filter(F.col("site_id") == site_id)
    hit = rules.filter("weight > 0").crossJoin(F.broadcast(slots)).filter((F.size("phrases") > 0) & F.forall("phrases", lambda p: phrase_matches(F.col("slots"), p)))
    return hit.groupBy("element_id").agg(F.sum("weight").alias("boost"))
