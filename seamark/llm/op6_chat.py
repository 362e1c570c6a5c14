"""Chat formatting with typed content parts.

A message's content is text, or a JSON array of parts: text, image, audio, document (which holds parts of its own), or plain strings. A
visitor walks the parts in order and flattens them to one text with a placeholder for each attachment, the list of
attachment references in the same order, and the number of tokens that placeholders and text expand to.

Messages are formatted on their own, as Arrow batches, and then put together by conversation in (turn, role, text) order on the JVM. Only what a conversation
holds comes together in one place.

Defined results: null content is an empty message; content that isn't a JSON array of parts (or is nested deeper than the JSON parser reads) is one text
part, whole; parts of unknown type, or not of the expected form, are kept as placeholders `<|unknown|>` and counted as one token, whatever
the depth, as the visitor keeps its own stack; numbers are clamped (widths and heights from 1, seconds from 0 to `most_seconds`, what is no finite number
counts as absent); characters that UTF-8 can't hold (lone surrogates) become U+FFFD; a null role is 'user'; repeated turns are all kept, in a fixed order;
rows with a null conv_id (or one that isn't a whole number) are one conversation; extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Format:
    start: str = "<|start|>"
    end: str = "<|end|>\n"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: tuple[str, str] = ("<|document|>", "<|/document|>")
    unknown: str = "<|unknown|>"
    #: An image is cut to patches of so many pixels, of which merge x merge make a token; so many at most.
    patch: int = 14
    merge: int = 2
    most_image_tokens: int = 1280
    audio_tokens_per_second: float = 12.5
    bytes_per_token: int = 4
    #: A longer audio part counts as so long (ten years).
    most_seconds: float = 315_360_000.0


class _End:
    """On the stack: the document opened last ends here."""


def clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Visitor:
    """Flattens parts; one visit_ method for each type. What is left to visit lies on a stack of its own, so depth has no limit."""

    format: Format
    text: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    tokens: int = 0
    stack: list = field(default_factory=list)

    def visit(self, part) -> None:
        self.stack.append(part)
        while self.stack:
            part = self.stack.pop()
            if isinstance(part, str):
                self.visit_text({"text": part})
            elif isinstance(part, list):
                self.stack += reversed(part)
            elif part is _End:
                self.leave_document()
            else:
                kind = part.get("type") if isinstance(part, dict) else None
                getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_unknown")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        text = clean(text) if isinstance(text, str) else ""
        # Text never passes for a placeholder.
        self.text.append(text.replace("<|", "<\u200b|"))
        self.tokens += math.ceil(len(text.encode()) / self.format.bytes_per_token)

    def attach(self, part: dict, kind: str, mark: str, tokens: int) -> None:
        url = part.get("url")
        self.text.append(mark)
        self.refs.append(f"{kind}:{clean(url) if isinstance(url, str) else ''}")
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        side, most = self.format.patch * self.format.merge, self.format.most_image_tokens
        # Beyond `most` patches a side no longer matters.
        w, h = (min(max(1, x), side * most) if isinstance(x := part.get(k), int) else side for k in ("width", "height"))
        self.attach(part, "image", self.format.image, min(most, -(-w // side) * -(-h // side)))

    def visit_audio(self, part: dict) -> None:
        s = part.get("seconds")
        if isinstance(s, float) and not math.isfinite(s) or not isinstance(s, (int, float)):
            s = 0
        s = float(min(max(s, 0), self.format.most_seconds))
        self.attach(part, "audio", self.format.audio, max(1, math.ceil(s * self.format.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document", self.format.document[0], 1)
        self.stack += [_End, part.get("parts") or []]

    def leave_document(self) -> None:
        self.text.append(self.format.document[1])
        self.tokens += 1

    def visit_unknown(self, part) -> None:
        self.text.append(self.format.unknown)
        self.tokens += 1


def flatten(content: str | None, form: Format) -> tuple[str, list[str], int]:
    v = Visitor(form)
    parts = content or ""
    if parts.lstrip()[:1] == "[":
        try:
            parts = json.loads(parts)
        except (ValueError, RecursionError):
            pass
    v.visit(parts)
    return "".join(v.text), v.refs, v.tokens


def _formatter(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [flatten(x, form) for x in b.column(3).to_pylist()]
            text = pa.array([m[0] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], text, pa.array([m[1] for m in made], pa.list_(pa.string())), pa.array([m[2] for m in made], pa.int64())], ["conv_id", "turn", "role", "text", "refs", "tokens"])

    return run


def format_chats(messages: DataFrame, form: Format | None = None) -> DataFrame:
    """(conv_id, messages, text, attachments, tokens) of each conversation; messages has conv_id, turn, role, content."""
    form = form or Format()
    given = messages.select(whole("conv_id").alias("conv_id"), whole("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.col("content").cast("string"))
    flat = given.mapInArrow(_formatter(form), "conv_id long, turn long, role string, text string, refs array<string>, tokens long")
    together = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "refs", "tokens"))).alias("m"))
    said = F.transform("m", lambda x: F.concat(F.lit(form.start), x["role"], F.lit("\n"), x["text"], F.lit(form.end)))
    return together.select(
        "conv_id", F.size("m").alias("messages"), F.array_join(said, "").alias("text"), F.array_join(F.flatten(F.col("m.refs")), ",").alias("attachments"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def with_parts(conversations: DataFrame) -> DataFrame:
    """The conversations table with typed content: its text, and attachments that follow from conv_id and turn (the table has none).

    Users of every third conversation show an image, of every fifth play audio; every fourth assistant turn cites a document with the text inside.
    """
    ref = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    j = lambda *c: F.to_json(F.struct(*c))
    image = j(F.lit("image").alias("type"), F.concat(F.lit("img/"), ref, F.lit(".png")).alias("url"), (F.col("conv_id") % 900 + 100).cast("int").alias("width"), (F.col("turn") * 50 + 200).cast("int").alias("height"))
    audio = j(F.lit("audio").alias("type"), F.concat(F.lit("audio/"), ref, F.lit(".wav")).alias("url"), (F.col("conv_id") % 30).cast("int").alias("seconds"))
    document = j(F.lit("document").alias("type"), F.concat(F.lit("doc/"), ref, F.lit(".pdf")).alias("url"), F.array(text).alias("parts"))
    user = F.col("role") == "user"
    parts = F.array(
        F.when(user & (F.col("conv_id") % 3 == 0), image),
        F.when((F.col("role") == "assistant") & (F.col("conv_id") % 4 == 0), document).otherwise(F.to_json(text)),
        F.when(user & (F.col("conv_id") % 5 == 0), audio),
    )
    content = F.concat(F.lit("["), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ","), F.lit("]"))
    return conversations.select("conv_id", "turn", "role", content.alias("content"))


ORACLE = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS safe,
    ceil(octet_length(encode(coalesce(text, ''))) / 4.0) AS n, conv_id || '-' || turn AS ref,
    role = 'user' AND conv_id % 3 = 0 AS image, role = 'user' AND conv_id % 5 = 0 AS audio, role = 'assistant' AND conv_id % 4 = 0 AS doc
  FROM conversations
), f AS (
  SELECT conv_id, turn, role,
    '<|start|>' || role || chr(10) || CASE WHEN image THEN '<|image|>' ELSE '' END || CASE WHEN doc THEN '<|document|>' || safe || '<|/document|>' ELSE safe END
      || CASE WHEN audio THEN '<|audio|>' ELSE '' END || '<|end|>' || chr(10) AS text, safe,
    concat_ws(',', CASE WHEN image THEN 'image:img/' || ref || '.png' END, CASE WHEN doc THEN 'document:doc/' || ref || '.pdf' END, CASE WHEN audio THEN 'audio:audio/' || ref || '.wav' END) AS refs,
    n + CASE WHEN image THEN least(1280, ceil((conv_id % 900 + 100) / 28.0) * ceil((turn * 50 + 200) / 28.0)) ELSE 0 END
      + CASE WHEN doc THEN 2 ELSE 0 END + CASE WHEN audio THEN greatest(1, ceil((conv_id % 30) * 12.5)) ELSE 0 END AS tokens
  FROM m
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS messages, string_agg(text, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(refs, ',' ORDER BY turn, role, text) FILTER (refs <> ''), '') AS attachments, CAST(sum(tokens) AS BIGINT) AS tokens
FROM f GROUP BY conv_id
"""
