"""Assembly of answers from search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import sanitize, tokens

REPLY = "summary string, sourceIds array<long>, confidence string"


def blocks(results: DataFrame) -> DataFrame:
    """results(element_id, title, url, content, rank) with block, the text of a source in a prompt, and its tokens."""
    one = lambda c, by: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]", by)
    body = sanitize(F.coalesce("content", F.lit("")))
    block = F.concat(F.lit("---\nTHE PAGE "), F.col("element_id"), F.lit("\nTitle: "), one("title", " "), F.lit("\nURL: "), one("url", ""), F.lit("\nContent:\n"), body, F.lit("\n---"))
    return results.withColumn("block", block).withColumn("block_tokens", tokens(F.col("block")))


def pack(results: DataFrame, budget: int) -> DataFrame:
    """The blocks that fit: the first always, then in rank order as long as the running sum is within budget, none after the first that isn't."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks(results).withColumn("used", F.sum("block_tokens").over(w)).withColumn("first", F.min("rank").over(w))
    return run.filter((F.col("rank") == F.col("first")) | (F.col("used") <= max(500, budget))).drop("first")


def context(packed: DataFrame) -> DataFrame:
    """(context, sources, tokens): all packed blocks in one text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return packed.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("sources"), F.coalesce(F.max("used"), F.lit(0)).alias("tokens"))


def messages(query: DataFrame, packed_context: DataFrame, streaming: bool = False, style: str = "Answer from the pages only.") -> DataFrame:
    """(role, content) of the prompt for query(query)."""
    closing = "Write markdown with inline [id] citations." if streaming else 'Reply with one JSON object of three keys: "summary" (text), "sourceIds" (a list of page ids), "confidence" (high, medium or low).'
    user = F.concat(F.lit("<user_query>\n"), sanitize(F.col("query")), F.lit("\n</user_query>\n\n"), F.col("context"), F.lit("\n\n" + closing))
    return query.crossJoin(F.broadcast(packed_context)).select(F.explode(F.array(F.struct(F.lit("system").alias("role"), F.lit(style).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))).alias("m")).select("m.*")


def parse(replies: DataFrame) -> DataFrame:
    """replies(reply) with summary, source_ids, confidence ('medium' if missing), citations, ok; malformed replies are not ok."""
    r = F.from_json(F.trim("reply"), REPLY)
    out = replies.withColumn("r", r)
    ok = F.col("r.summary").isNotNull()
    cited = F.regexp_extract_all(F.col("r.summary"), F.lit("\\[(\\d+)\\]"), F.lit(1))
    return out.select("*", F.col("r.summary").alias("summary"), F.coalesce("r.sourceIds", F.array().cast("array<bigint>")).alias("source_ids"), F.when(ok, F.coalesce("r.confidence", F.lit("medium"))).alias("confidence"), cited.alias("citations"), ok.alias("ok")).drop("r")


def sources(parsed: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """(reply_id, element_id, title, url, rank): the results that a reply names, in its order, `limit` at most; unknown ids are skipped."""
    named = parsed.select("reply_id", F.posexplode("source_ids").alias("pos", "element_id")).join(results.select("element_id", "title", "url"), "element_id")
    w = Window.partitionBy("reply_id").orderBy("pos")
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("reply_id", "element_id", "title", "url", "rank")


def fallback(results: DataFrame) -> DataFrame:
    """The answer's shape when the budget is spent: results as sources, no summary."""
    return results.select("element_id", F.lit(None).cast("string").alias("summary"), F.lit(True).alias("budget_exhausted"))


def default_budget(s: Settings) -> int:
    return max(500, s.prompt_tokens)
