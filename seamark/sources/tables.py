"""Tables by name, and the engine's input tables as views over generic ones (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cost, prices

NOW = "2024-01-31 00:00:00"
SITES = ((1, "English", "en", "en"), (2, "German", "de", "de"), (3, "French", "fr", "fr"), (4, "Spanish", "es", "es"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITES), "site_id int, name string, handle string, language string")


def sections(spark: SparkSession) -> DataFrame:
    """(section_id, handle)."""
    return spark.createDataFrame([(k, f"section-{k}") for k in range(10)], "section_id int, handle string")


def _site(lang):
    return F.when(lang == "en", 1).when(lang == "de", 2).when(lang == "fr", 3).when(lang == "es", 4)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element_id, site_id, section_id, title, url, status, updated, text)."""
    d = F.col("doc_id")
    title = F.array_join(F.slice(F.split(F.trim("text"), "\\s+", 7), 1, 6), " ")
    return read(spark, sf_dir, "documents").select(
        d.alias("element_id"), _site(F.col("lang")).alias("site_id"), (d % 10).cast("int").alias("section_id"), title.alias("title"),
        F.when(d % 50 != 7, F.concat(F.lit("/d/"), d)).alias("url"), F.when(d % 40 == 3, "disabled").otherwise("enabled").alias("status"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(doc_id % 60 AS INT))").alias("updated"), "text",
    )


def typed_fields(text, updated, section):
    """Fields of an entry: its text, a date, a table, and some that give no text."""
    one = lambda handle, kind, value, searchable=True: F.struct(F.lit(handle).alias("handle"), F.lit(kind).alias("kind"), F.lit(searchable).alias("searchable"), value.cast("string").alias("value"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), '(?s)^[{]"v":(.*)[}]$', 1)
    facts = F.concat(F.lit('["<b>Section</b>", '), section.cast("string"), F.lit(', true, null, [" nested "]]'))
    return F.array(
        one("body", "text", quoted(text)), one("when", "date", quoted(F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss"))), one("facts", "table", facts), one("link", "link", F.lit('"x"')),
        one("secret", "text", F.lit('"hidden"'), False), one("gone", "text", F.lit(None)), one("blank", "table", F.lit('[" ", {"a": false}]')),
    )


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").join(bad, "doc_id", "left_semi").select(F.col("doc_id").alias("element_id"), _site(F.col("lang")).alias("site_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every line: (element_id, site_id, section_id, chunk, chunks, title, body)."""
    # Lines are cut and counted before they are dealt out: beside the generator, their number would be worked out from the whole text for each line.
    e = entries(spark, sf_dir).withColumn("lines", F.split("text", "\n", -1)).withColumn("chunks", F.size("lines"))
    return e.select("element_id", "site_id", "section_id", "title", "chunks", F.posexplode("lines").alias("chunk", "body"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element_id, site_id, section_id, chunk, vector, indexed): four to an element."""
    v = read(spark, sf_dir, "embeddings").select((F.col("vec_id").cast("long") / 4).cast("long").alias("element_id"), (F.col("vec_id") % 4).cast("int").alias("chunk"), F.col("embedding").alias("vector"))
    v = v.withColumn("indexed", F.expr("timestamp'2024-02-01' - make_interval(0, 0, 0, CAST(element_id % 45 AS INT))"))
    return v.join(entries(spark, sf_dir).select("element_id", "site_id", "section_id"), "element_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search log, with derived total_tokens, cost, and has_error."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").withColumn("k", k)
    smart = F.col("event_type").isin("view", "click")
    word = F.concat("event_type", F.lit(" "), (F.col("k") % 20).cast("string"))
    word = F.when(F.col("k") % 3 == 0, F.upper(word)).otherwise(word)
    word = F.when(F.col("k") % 5 == 0, F.concat(F.lit("  "), word, F.lit(" "))).otherwise(word)
    h = e.select(
        F.col("event_id").alias("id"), F.when(smart, "smart").otherwise("aiAnswer").alias("type"), F.when(F.col("k") == 99, "").otherwise(word).alias("query"),
        F.when(F.col("user_id") % 10 != 0, (F.col("user_id") % 4 + 1).cast("int")).alias("site_id"), (F.col("k") % 7).alias("results"), F.col("k").alias("embedding_tokens"),
        F.when(smart, 0).otherwise(F.col("k") * 10).alias("tokens_in"), F.when(smart, 0).otherwise(F.col("k") * 3).alias("tokens_out"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"), (F.col("k") % 3 == 0).alias("cached"), (F.col("event_type") == "error").alias("has_error"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("k").cast("string"))).alias("error"), F.lit("text-embedding-3-small").alias("embedding_model"), F.when(~smart, "gpt-medium").alias("answer_model"), F.col("ts").alias("created"),
        F.col("user_id").alias("user_id"),
    )
    return derive(h)


def derive(log: DataFrame) -> DataFrame:
    """Adds total_tokens and cost by the models' prices."""
    p = F.broadcast(prices(log.sparkSession))
    a = p.select(F.col("model").alias("embedding_model"), F.col("price_in").alias("e_in"))
    b = p.select(F.col("model").alias("answer_model"), F.col("price_in").alias("a_in"), F.col("price_out").alias("a_out"))
    both = log.join(a, "embedding_model", "left").join(b, "answer_model", "left")
    total = cost(F.col("embedding_tokens"), F.lit(0), F.col("e_in"), F.lit(0.0)) + cost(F.col("tokens_in"), F.col("tokens_out"), F.col("a_in"), F.col("a_out"))
    return both.withColumn("total_tokens", F.col("embedding_tokens") + F.col("tokens_in") + F.col("tokens_out")).withColumn("cost", total.cast("decimal(10,6)")).drop("e_in", "a_in", "a_out")


def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of each element: (element_id, site_id, phrases, weight), by its title's first two lexemes; every tenth has one more of two phrases."""
    from ..functions.text import lexemes

    e = entries(spark, sf_dir).select("element_id", "site_id", lexemes(F.col("title")).alias("w")).filter(F.size("w") >= 3)
    one = e.select("element_id", "site_id", F.array(F.slice("w", 1, 2)).alias("phrases"), (F.col("element_id") % 5 * 0.01).alias("weight"))
    two = e.filter("element_id % 10 = 0").select("element_id", "site_id", F.array(F.slice("w", 1, 1), F.slice("w", 3, 1)).alias("phrases"), F.lit(0.02).alias("weight"))
    return one.unionByName(two)
