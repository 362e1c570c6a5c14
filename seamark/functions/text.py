"""Text functions. Column in, column out; JVM expressions but where a comment says otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date, datetime, time
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BYTES_PER_TOKEN, EMBEDDING_BYTES, Settings


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("int")


def chars(n: Column) -> Column:
    return n * BYTES_PER_TOKEN


def is_empty(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(" \t\n\r\v\0")), F.lit("")) == ""


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C; Spark has no such function. ASCII texts pass as they are."""
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def sanitize(text: Column, normalize: bool = True) -> Column:
    """NFC, no control characters but line ends and tabs, no chat control sequences, no code fences at line starts, trimmed."""
    x = nfc(text) if normalize else text
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")
    x = F.regexp_replace(x, "<\\|[^|>]*\\|>", "")
    x = F.regexp_replace(x, "(^|\\n)\\s*(```+|~~~+)", "$1")
    return F.trim(x, F.lit(" \t\n\r\v\0"))


def sanitize_text(text: str) -> str:
    """sanitize() of one text that lies on the driver."""
    x = unicodedata.normalize("NFC", text)
    for pattern, by in ((r"[\x00-\x08\x0B-\x1F\x7F]", ""), (r"<\|[^|>]*\|>", ""), (r"(^|\n)\s*(```+|~~~+)", r"\1")):
        x = re.sub(pattern, by, x)
    return x.strip(" \t\n\r\v\0")


def head_bytes(text: Column, n: int) -> Column:
    """The longest start of at most n bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    back = sum((F.when(_continues(raw, n, k), 1).otherwise(0) for k in range(1, 4)), F.lit(0))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(n) - back), "UTF-8"))


def _continues(raw: Column, n: int, k: int) -> Column:
    """The k bytes up to the one after the cut at n, read backwards, are all of the form 10xxxxxx."""
    out = F.lit(True)
    for j in range(k):
        byte = F.conv(F.hex(F.substring(raw, n + 1 - j, 1)), 16, 10).cast("int")
        out = out & (byte.bitwiseAND(0xC0) == 0x80)
    return out


def embedding_input(text: Column) -> Column:
    return head_bytes(sanitize(text), EMBEDDING_BYTES)


def strip_tags(html: Column) -> Column:
    """Without comments and tags, by patterns: a tag is a < before a letter, / or !, up to the next >."""
    return F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "<[A-Za-z/!?][^>]*>", "")


class _Stripper(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.out.append(f"&#{name};")


def parse_strip(text: str) -> str:
    """Tags go, their text stays, with quoted attributes understood; entities stay as they are."""
    if "<" not in text and "&" not in text:
        return text
    p = _Stripper()
    p.feed(text)
    p.close()
    return "".join(p.out)


@F.arrow_udf(T.StringType())
def strip_tags_exact(html: pa.Array) -> pa.Array:
    return pa.array([None if x is None else parse_strip(x) for x in html.to_pylist()], pa.string())


def lexemes(text: Column) -> Column:
    """Words of letters, digits and underscores, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def clean_lexeme(word: Column) -> Column:
    return F.regexp_replace(word, "[^\\p{L}\\p{N}_]+", "")


def split_blank(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(text)), "\\s+"), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Distinct clean lexemes of at least two characters."""
    return F.array_distinct(F.filter(F.transform(split_blank(text), clean_lexeme), lambda x: F.length(x) >= 2))


def positions(text: Column) -> Column:
    """Every token with its 1-based position; a word has three letters or more and nothing else."""
    return F.transform(split_blank(text), lambda x, i: F.struct(x.alias("raw"), (i + 1).alias("pos"), x.rlike("^\\p{L}{3,}$").alias("word")))


def excerpt(content: Column, title: Column, length: int = Settings.excerpt) -> Column:
    """Without tags and the title in front, cut to `length` characters (the last of them an ellipsis)."""
    clean = strip_tags(F.trim(content, F.lit(" \t\n\r\v\0")))
    rest = F.when(title.isNotNull() & clean.startswith(title), F.trim(F.substring(clean, F.length(title) + 1, F.length(clean)), F.lit(" \t\n\r\v\0"))).otherwise(clean)
    return F.coalesce(F.when(F.length(rest) > length, F.concat(F.substring(rest, 1, length - 1), F.lit("…"))).otherwise(rest), F.lit(""))


def join_fields(*texts: Column) -> Column:
    """Texts that are not null, empty, or '0', with a blank line between."""
    return F.array_join(F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != "") & (x != "0")), "\n\n")


# --- Extraction from typed fields -------------------------------------------------------------------------------------------


def flatten_value(value) -> str:
    """Text of nested lists, maps, strings and numbers, joined by blanks; strings lose their tags."""
    if isinstance(value, str):
        return parse_strip(value.strip())
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, dict):
        value = list(value.values())
    return " ".join(x for x in map(flatten_value, value) if x.strip())


def _moment(value) -> datetime | date | time | None:
    if isinstance(value, (date, time)):
        return value
    try:
        return datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None


def field_text(kind: str, value) -> str:
    """Text of a field by its kind: link, asset, category, tag give none; date and time are written out; relations give titles; entries their fields."""
    if value is None or kind in ("link", "asset", "category", "tag"):
        return ""
    if kind in ("date", "time"):
        at = _moment(value)
        return "" if at is None else f"{at:%H:%M}" if kind == "time" else f"{at:%B} {at.day}, {at.year}"
    if kind in ("relation", "entries", "blocks") and isinstance(value, list):
        rows = [x for x in value if isinstance(x, dict)]
        if kind == "relation":
            return ", ".join(str(x["title"]) for x in rows if str(x.get("title") or "").strip())
        if kind == "entries":
            own = ([field_text(f["kind"], f["value"]) for f in e.get("fields", []) if f.get("searchable", True)] for e in rows)
            return " ".join(x for x in (" ".join(t for t in texts if t.strip()) for texts in own) if x)
        return " ".join(x for x in (flatten_value(list(b.get("fields", {}).values())) for b in rows) if x)
    return parse_strip(value) if isinstance(value, str) else flatten_value(value)


def field_report(kind: str, value, searchable: bool = True) -> tuple[str, str]:
    """(text, reason); the reason is empty if the field gives text."""
    if not searchable:
        return "", "searchable=false"
    if kind in ("link", "asset", "category", "tag"):
        return "", "skipped"
    if value is None:
        return "", "null value"
    text = field_text(kind, value)
    return text, "" if text.strip() else "no extractable text"


def block_report(blocks: list[dict]) -> list[tuple[str, str]]:
    """(label, text) of nested blocks; labels are `type #n`."""
    return [(f"{b.get('type', 'block')} #{n}", flatten_value(list(b.get("fields", {}).values()))) for n, b in enumerate((b for b in blocks if isinstance(b, dict)), 1)]


# --- Chunks -----------------------------------------------------------------------------------------------------------------


SLICE = 200


def _size(text: str) -> int:
    return -(-len(text.encode()) // BYTES_PER_TOKEN)


def cut_bytes(text: str, most: int) -> list[str]:
    """Pieces of at most `most` bytes, cut between characters, trimmed, empty ones left out."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "ignore").strip())
        at = end
    return [x for x in out if x]


def overlap_of(text: str, overlap: int) -> str:
    """The last 4 * overlap bytes of a longer text, from after their first blank; 0 is no overlap."""
    most = overlap * BYTES_PER_TOKEN
    raw = text.encode()
    if not overlap or len(raw) <= most:
        return ""
    tail = raw[-most:].decode("utf-8", "ignore")
    return tail.partition(" ")[2].strip() if " " in tail else tail.strip()


def split_sentences(text: str, s: Settings) -> list[str]:
    out, now, n = [], "", 0
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        t = _size(sentence)
        if t > s.most_chunk:
            if now.strip():
                out.append(now.strip())
            out += cut_bytes(sentence, s.most_chunk * BYTES_PER_TOKEN)
            now, n = "", 0
        elif n + t > s.target_chunk and now.strip():
            out.append(now.strip())
            now, n = sentence, t
        else:
            now = f"{now} {sentence}" if now else sentence
            n += t
    if now.strip():
        out.append(now.strip())
    return out


def chunk_text(text: str, s: Settings) -> list[str]:
    """Paragraphs packed to about the target size, with overlap; long paragraphs by sentences, long sentences by bytes."""
    if _size(text) < s.chunk_threshold:
        return [text]
    out, now, n = [], "", 0
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        t = _size(p)
        if t > s.most_chunk:
            if now.strip():
                out.append(now.strip())
            out += split_sentences(p, s)
            now, n = "", 0
        elif n + t > s.target_chunk and n >= s.least_chunk:
            out.append(now.strip())
            o = overlap_of(now, s.overlap)
            now = f"{o}\n\n{p}" if o else p
            n = _size(now)
        else:
            now = f"{now}\n\n{p}" if now else p
            n += t
    if now.strip():
        out.append(now.strip())
    return out or [text]


def chunks(s: Settings) -> Callable[[Column], Column]:
    """A column of chunks. Python over Arrow batches: the packing is a fold with several kinds of state."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(text: pa.Array) -> pa.Array:
        # In slices, so that of a batch only few texts and chunks are Python's at a time.
        parts = (text.slice(k, SLICE).to_pylist() for k in range(0, len(text), SLICE))
        made = [pa.array([None if x is None else chunk_text(x, s) for x in part], pa.list_(pa.string())) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    return run
