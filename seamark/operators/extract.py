"""Entries with typed fields to text, to a report of what gives text, and on to indexed chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import text
from ..hooks import Hooks
from . import boosts, index

#: A field: its value is JSON, as the values of different kinds have different forms.
FIELDS = "array<struct<handle:string,kind:string,searchable:boolean,value:string>>"
_REPORT = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("handle", "kind", "reason", "text")] + [T.StructField("searchable", T.BooleanType()), T.StructField("indexed", T.BooleanType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])))]))


def _value(raw: str | None):
    try:
        return None if raw is None else json.loads(raw)
    except (ValueError, RecursionError):
        return raw  # not JSON: the text itself


def inspect_fields(fields: list[dict] | None, hooks: Hooks) -> list[dict]:
    """Each field with its text, or the reason why it gives none; blocks are listed by label."""
    out = []
    for f in fields or []:
        kind, value = f["kind"] or "text", _value(f["value"])
        searchable = f["searchable"] is not False
        found, reason = text.field_report(kind, value, searchable)
        if reason in ("", "no extractable text"):
            found = hooks.text_of_field(f["handle"], kind, found)
            reason = "" if found.strip() else "no extractable text"
        blocks = text.block_report(value) if kind == "blocks" and isinstance(value, list) else []
        out.append({"handle": f["handle"], "kind": kind, "reason": reason, "text": "" if reason else found, "searchable": searchable, "indexed": not reason, "blocks": [{"label": a, "text": b} for a, b in blocks]})
    return out


def report(hooks: Hooks | None = None) -> Callable[[Column], Column]:
    """A column of reports from a column of fields."""
    hooks = hooks or Hooks()

    @F.arrow_udf(_REPORT)
    def run(fields: pa.Array) -> pa.Array:
        made = [inspect_fields(x, hooks) for x in fields.to_pylist()]
        return pa.array(made, pa.list_(pa.struct([*((c, pa.string()) for c in ("handle", "kind", "reason", "text")), ("searchable", pa.bool_()), ("indexed", pa.bool_()), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())])))])))

    return run


def entry_text(title: Column, reported: Column) -> Column:
    """Title and field texts with a blank line between, those without text left out."""
    parts = F.concat(F.array(title), F.transform(reported, lambda f: f["text"]))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "") & (x != "0")), "\n\n")


def with_chunks(entries: DataFrame, s: Settings, hooks: Hooks | None = None) -> DataFrame:
    """entries(element_id, site_id, section_id, title, url, status, updated, fields) with text and chunks, as index.sync() takes them."""
    made = entries.withColumn("text", entry_text(F.col("title"), report(hooks)(F.col("fields"))))
    return made.drop("fields").withColumn("chunks", text.chunks(s)(F.col("text")))


def index_entries(stored: DataFrame, entries: DataFrame, excluded: DataFrame, now: str, s: Settings, hooks: Hooks | None = None) -> DataFrame:
    """The index (with vectors) after all entries were extracted, chunked and synced. Only chunks without a vector are embedded: those of entries that changed."""
    hooks = hooks or Hooks()
    after = index.sync(stored.drop("vector"), with_chunks(entries, s, hooks), excluded, now)
    known = stored.select("element_id", "site_id", "chunk", F.col("content_hash").alias("h"), "vector")
    same = ["element_id", "site_id", "chunk"]
    both = after.join(known, same, "left")
    vector = F.when(F.col("h") == F.col("content_hash"), F.col("vector"))
    kept = both.withColumn("vector", vector).drop("h")
    # Two branches, so that texts with vectors never reach Python.
    return kept.filter("vector IS NOT NULL").unionByName(kept.filter("vector IS NULL").withColumn("vector", hooks.embedding()(text.embedding_input(F.col("body")))))


def sync_boosts(stored: DataFrame, entries: DataFrame, hooks: Hooks) -> DataFrame:
    """stored with the rules of all these entries replaced by those that listeners give, whether or not the entry's text changed."""
    live = index.eligible(entries)
    rule = F.explode(hooks.rules()(F.col("element_id"), F.col("site_id"), F.col("title"))).alias("r")
    new = live.select("element_id", "site_id", rule).select("element_id", "site_id", "r.terms", "r.weight")
    return boosts.sync(stored, new, live)
