"""Benchmark decontamination with an Aho-Corasick automaton.

Test questions and answers and documents go through one normaliser (`normal_of`: runs of letters and digits, lower case, one blank
between), so an exact copy has an equal normal form whatever its script. The patterns are all passages of `words` consecutive words of an
item, and whole items that are shorter; one automaton over them scans each text once. Overlapping hits of an item merge
into one span, given in characters of the original text, which is looked up only in documents that have a hit, by the
same word class: every character of such a text is classed by the normaliser's own expression.

The benchmark is not part of the corpus and doesn't grow with it. Its patterns are still measured: beyond `most_chars`
characters the items are dealt to several automata, each in a scan of its own, so that no worker holds more than one.
Dropping is a filter on the row itself: nothing is shuffled or joined.

Defined results: null or empty texts and items match nothing, and so do items without a letter or digit; an item of fewer than
`words` words matches as a whole, at word bounds; items with one item_id are one item, repeated rows of documents too; rows
with a null doc_id are reported with a null doc_id, and dropped like any other if they hold a passage; ids that aren't whole numbers count as
null ones, and items with such an id still match (item_id is then null); only doc_id, text, item_id are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_chunk, slices, whole

WORDS, MOST_CHARS = 13, 50_000_000
HITS = "doc_id long, item_id long, start long, end long, words int"
_NO_WORD = r"[^\pL\pN]+"
_built: dict = {}
_is_word: dict[str, bool] = {}


def normal_of(text: pa.Array) -> list[str]:
    """The normal form of each text, with a blank at either end. A final sigma counts as a sigma, as upper case has one form."""
    low = pc.utf8_lower(pc.replace_substring_regex(text, _NO_WORD, " "))
    return [" " + x.strip(" ") + " " for x in pc.replace_substring(low, "ς", "σ").to_pylist()]


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, in characters, by the normaliser's word class."""
    seen = set(text)
    if new := sorted(seen - _is_word.keys()):
        _is_word.update(zip(new, (x != " " for x in pc.replace_substring_regex(pa.array(new), _NO_WORD, " ").to_pylist())))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.fromiter((ord(c) for c in seen if _is_word[c]), np.uint32)
    step = np.diff(np.isin(codes, kinds).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def patterns(items: list[tuple[int | None, str | None]], words: int = WORDS) -> dict[str, list[int | None]]:
    """Normalised passage to the items that have it."""
    out: dict[str, list[int | None]] = {}
    for (item, _), normal in zip(items, normal_of(pa.array([t or "" for _, t in items], pa.string()))):
        w = normal.split()
        for i in range(max(1, len(w) - words + 1) if w else 0):
            mine = out.setdefault(" " + " ".join(w[i : i + words]) + " ", [])
            if not mine or mine[-1] != item:
                mine.append(item)
    return out


def _automaton(key: str, wanted: dict[str, list[int | None]]):
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for p, items in wanted.items():
            a.add_word(p, (p.count(" ") - 1, items))
        a.make_automaton()
        _built[key] = a
    return _built[key]


def spans(automaton, normal: str, text: str) -> list[tuple[int | None, int, int, int]]:
    """(item_id, start, end, words) of the merged hits; end is exclusive."""
    found: dict[int | None, list[list[int]]] = {}
    seen_at, seen_words = 0, 0
    for end, (n, items) in automaton.iter(normal):
        seen_words += normal.count(" ", seen_at, end + 1)
        seen_at = end + 1
        last = seen_words - 1  # words before the blank at end
        for item in items:
            mine = found.setdefault(item, [])
            if mine and last - n <= mine[-1][1]:
                mine[-1] = [min(mine[-1][0], last - n), max(mine[-1][1], last)]
            else:
                mine.append([last - n, last])
    if not found:
        return []
    starts, ends = word_spans(text)
    return [(item, int(starts[a]), int(ends[b - 1]), b - a) for item, all_ in found.items() for a, b in all_]


def _scanner(patterns_of, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, patterns_of.value)
        for b in batches:
            all_ids, all_text = b.column(0), one_chunk(b.column(1))
            for s, e in slices(all_text):
                text = all_text.slice(s, e - s)
                rows = []
                for k, x in enumerate(normal_of(text)):
                    if next(automaton.iter(x), None) is not None:
                        rows += [(all_ids[s + k].as_py(), *hit) for hit in spans(automaton, x, text[k].as_py())]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()])], ["doc_id", "item_id", "start", "end", "words"])

    return scan


def _hitter(patterns_of, key: str):
    """A predicate on text: it holds a passage."""

    @F.arrow_udf(T.BooleanType())
    def hit(text: pa.Array) -> pa.Array:
        automaton, out = _automaton(key, patterns_of.value), []
        text = one_chunk(text)
        for s, e in slices(text):
            out += [next(automaton.iter(x), None) is not None for x in normal_of(text.slice(s, e - s))]
        return pa.array(out, pa.bool_())

    return hit


def shards(items: DataFrame, words: int, most_chars: int) -> list[tuple]:
    """(broadcast patterns, key) of each automaton; the benchmark is fetched part by part."""
    sent: list[dict[str, list[int | None]]] = [{}]
    size, last = 0, None
    for r in items.select(whole("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if size > most_chars and r[0] != last:  # an item stays in one
            sent.append({})
            size = 0
        last = r[0]
        for p in patterns([(r[0], r[1])], words):
            mine = sent[-1].setdefault(p, [])
            size += 0 if mine else len(p)
            if mine[-1:] != [r[0]]:
                mine.append(r[0])
    out = []
    for k, shard in enumerate(s for s in sent if s):
        b = items.sparkSession.sparkContext.broadcast(shard)
        out.append((b, f"{id(b)}-{b._jbroadcast.id() if b._jbroadcast else k}"))
    return out


def contamination(docs: DataFrame, items: DataFrame, words: int = WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, words): the passages of test items in documents."""
    given = docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sent, key in shards(items, words, most_chars):
        part = given.mapInArrow(_scanner(sent, key), HITS)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """docs without the rows that hold a passage of a test item. Each row is judged by its own text, also without a doc_id."""
    for sent, key in shards(items, words, most_chars):
        docs = docs.filter(~_hitter(sent, key)(F.col("text").cast("string")))
    return docs
