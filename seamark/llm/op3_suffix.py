"""Suffix-array deduplication: passages of at least `least` words that two or more documents share.

The suffixes that matter are sorted by a distributed merge sort that knows common prefixes: tasks sort their suffixes into runs, runs are front-coded
(the length of the prefix that a suffix shares with the one before it, and its other words) and exchanged, and a loser tree merges
the runs of a part. A contender keeps the length of its prefix shared with the last winner, so two contenders are only compared from
there on. Adjacent prefix lengths in the merged order then tell which passages repeat.

Which suffixes matter: in every window of `least` words the smallest hash of `gram` consecutive words marks an anchor. Equal
passages have equal anchors, so a passage that repeats has an anchor whose gram repeats; anchors whose gram lies in one document only are dropped by a
count (no text is sent for that). The others' suffixes are sorted, each with the words before it, from which every start of
a window around the anchor is checked. The result is exact: it is that of sorting the suffixes of all words. Suffixes
whose first gram is equal always meet in one part: parts are dealt by that gram's hash, so no sampling is needed and parts are even.

A part is as much as one task holds in memory: there are as many as shuffle partitions, and more if the measured number of suffixes asks for it (`PLACES` to a part). A gram
that more than `hot` places have would make one part of any size: its suffixes aren't sorted in one place, but every window of `least` words around its
anchors is hashed where it lies, and the hashes are counted with partial aggregation, which gives the same windows.
The anchors are found and counted as the query is built.

Words are split at ASCII blanks and compared as they are. Defined results: null, empty and shorter texts share nothing; passages within one document only don't
count; rows with a null doc_id, or one that isn't a whole number, are left out; rows with one doc_id are one document, whose passages are given together; overlapping or
touching passages are one; a text of any length is processed whole; other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, one_chunk, pair, slices, whole, written

LEAST, GRAM = 50, 16
#: Suffixes to a part, and places of one gram that are sorted together, at most.
PLACES, HOT = 150_000, 20_000
#: A run is made of so many bytes of text (or one longer text), to bound a task's memory.
RUN_BYTES = 12 << 20


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for every i, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    extra = width - done
    return pick(out[: len(out) - extra], out[extra:]) if extra else out


def anchors(w: Words, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash of the gram there) of the anchors."""
    n = len(w.hashes)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = w.hashes
    done = 1
    while done < gram:  # gram is a power of 2
        g = pair(g[: len(g) - done], g[done:])
        done *= 2
    width = least - gram + 1
    low = _sliding(g, width, np.minimum)  # by the window's start
    ends = w.start[w.row + 1]
    within = np.arange(len(low)) + least <= ends[: len(low)]
    low = np.where(within, low, U64(0))
    # An anchor is the least of some window that holds it.
    padded = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
    high = _sliding(padded, width, np.maximum)[: len(g)]
    at = np.flatnonzero(high == g)
    return at, g[at]


def _find_anchors(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = one_chunk(b.column(1))
            ids = b.column(0).to_numpy()
            for s, e in slices(text):
                w = Words(text.slice(s, e - s))
                at, key = anchors(w, least, gram)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][w.row[at]]), pa.array((at - w.start[w.row[at]]).astype(np.int32)), pa.array(key.view(np.int64))], ["doc_id", "pos", "key"])

    return run


def encode_run(shared: np.ndarray, tails: list[str], left: list[str], ids: np.ndarray, pos: np.ndarray) -> bytes:
    """A sorted run, front-coded: words shared with the suffix before, the other words, the words before the anchor, doc_id, position."""
    rest, before = ("\n".join(x).encode() for x in (tails, left))
    head = struct.pack("<III", len(ids), len(rest), len(before))
    return zstandard.compress(head + shared.astype(np.int16).tobytes() + ids.astype(np.int64).tobytes() + pos.astype(np.int32).tobytes() + rest + before, 1)


def decode_run(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """(shared prefix lengths, doc_ids, positions, other words, left words)."""
    raw = zstandard.decompress(data)
    n, tails, left = struct.unpack_from("<III", raw)
    p = 12
    arrays = []
    for kind in (np.int16, np.int64, np.int32):
        arrays.append(np.frombuffer(raw, kind, n, p))
        p += arrays[-1].nbytes
    return (*arrays, raw[p : p + tails].decode().split("\n"), raw[p + tails : p + tails + left].decode().split("\n"))


def prefix(a: list[str], b: list[str], n: int) -> int:
    """The number of leading words that a and b share, given that they share n."""
    most = min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def merge_runs(runs: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(run, index in it, words shared with the one before, words) in the order of all suffixes: an LCP loser tree over decoded runs."""
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    now: list[list[str] | None] = [r[3][0].split(" ") if len(r[3]) and len(r[0]) else None for r in runs] + [None] * (size - k)
    at = [0] * size
    known = [0] * size  # words shared with the last winner
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = prefix(x, y, known[a])
        less = n == len(x) if n == len(x) or n == len(y) else x[n] < y[n]
        if less:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if size > 1 else 0
    while now[win] is not None:
        words = now[win]
        yield win, at[win], known[win], len(words)
        shared, rest = runs[win][0], runs[win][3]
        at[win] += 1
        i = at[win]
        if i < len(shared):
            n = int(shared[i])
            now[win] = words[:n] + rest[i].split(" ") if rest[i] else words[:n]
            known[win] = n
        else:
            now[win] = None
        node = (win + size) >> 1
        while node:
            win, loser[node] = play(win, loser[node])
            node >>= 1


def _joined(w: Words, at: np.ndarray, step: int, count: np.ndarray) -> list[str]:
    """For each k the count[k] words at[k], at[k] + step, ..., joined by blanks."""
    ends = np.concatenate([[0], np.cumsum(count)])
    index = np.repeat(at, count) + step * (np.arange(ends[-1]) - np.repeat(ends[:-1], count))
    words = w.vocab.take(pa.array(w.ids[index]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ").to_pylist()


def sorted_runs(w: Words, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, least: int, gram: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, run) of the suffixes at these places: sorted as arrays of word ranks, cut by part, front-coded."""
    start, end = w.start[row] + pos, w.start[row + 1]
    ok = start + gram <= end  # others are places of another row with this doc_id
    row, pos, start, end = row[ok], pos[ok], start[ok], end[ok]
    if not len(row):
        return
    h = w.hashes[start[:, None] + np.arange(gram)]
    while h.shape[1] > 1:
        h = pair(h[:, ::2], h[:, 1::2])
    part = (h[:, 0] % U64(parts)).astype(np.int64)
    rank = np.empty(len(w.vocab), np.uint32)
    rank[pc.sort_indices(w.vocab).to_numpy()] = np.arange(1, len(w.vocab) + 1)
    length = np.minimum(least, end - start)
    across = np.arange(least)
    ranks = np.where(across < length[:, None], rank[w.ids[np.minimum(start[:, None] + across, len(w.ids) - 1)]], 0)
    key = np.column_stack([part, ranks]).astype(">u4")
    order = np.argsort(key.view(f"S{key.shape[1] * 4}")[:, 0], kind="stable")
    row, pos, start, part, length, ranks = (x[order] for x in (row, pos, start, part, length, ranks))
    apart = ranks[1:] != ranks[:-1]
    shared = np.concatenate([[0], np.where(apart.any(1), apart.argmax(1), least)])
    shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    shared[first] = 0
    tails = _joined(w, start + shared, 1, length - shared)
    left = _joined(w, start - 1, -1, np.minimum(pos, least - gram))
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
        yield int(part[s]), encode_run(shared[s:e], tails[s:e], left[s:e], ids[row[s:e]], pos[s:e])


def _front_code(least: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = one_chunk(b.column(1))
            ids, places = b.column(0).to_numpy(), b.column(2)
            for s, e in slices(text, RUN_BYTES):
                mine = places.slice(s, e - s)
                row = np.repeat(np.arange(e - s), pc.list_value_length(mine).to_numpy(zero_copy_only=False).astype(np.int64))
                made = list(sorted_runs(Words(text.slice(s, e - s)), row, mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids[s:e], least, gram, parts))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], ["part", "run"])

    return run


def repeats(shared: np.ndarray, length: np.ndarray, ids: np.ndarray, pos: np.ndarray, left: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, end) of the windows of `least` words around sorted anchors that two documents have, neighbours joined."""
    n, most = len(ids), least - gram
    before = Words(pa.array(left, pa.string()))
    have = np.diff(before.start)
    node = np.zeros(n, U64)
    marks = np.zeros((n, most + 3), np.int8)  # by the words before the anchor, with a margin on either side
    for back in range(most + 1):
        if back:
            k = np.flatnonzero(have >= back)
            node[k] = pair(node[k], before.hashes[before.start[k] + back - 1])
        k = np.flatnonzero((length >= least - back) & (have >= back))
        if not len(k):
            continue
        right = np.cumsum(shared < least - back).astype(U64)
        code = pair(right[k], node[k])
        order = np.argsort(code, kind="stable")
        code, who = code[order], ids[k][order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        apart = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        marks[k[order], back + 1] = np.repeat(apart, np.diff(first, append=len(code)))
    step = np.diff(marks, axis=1)
    a, b = np.nonzero(step == 1), np.nonzero(step == -1)  # both by row and then by back: they pair up
    return ids[a[0]], pos[a[0]] - (b[1] - 1), pos[a[0]] - a[1] + least


def _merge(least: int, gram: int):
    def run(t: pa.Table) -> pa.Table:
        runs = [decode_run(x) for x in t.column("run").to_pylist()]
        order = np.array(list(merge_runs(runs)), np.int64).reshape(-1, 4)
        base = np.cumsum([0] + [len(r[0]) for r in runs])
        k = base[order[:, 0]] + order[:, 1]
        ids, pos = (np.concatenate([r[c] for r in runs])[k] for c in (1, 2))
        left = [x for r in runs for x in r[4]]
        doc, s, e = repeats(order[:, 2], order[:, 3], ids, pos.astype(np.int64), [left[i] for i in k], least, gram)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64())})

    return run


def window_hashes(w: Words, least: int) -> np.ndarray:
    """The hash of the `least` words from each word on (rows don't matter here), from those of 1, 2, 4, ... words."""
    n = max(0, len(w.hashes) - least + 1)
    out, done, level, width = None, 0, w.hashes, 1
    while width <= least:
        if least & width:
            part = level[done : done + n]
            out = part if out is None else pair(out, part)
            done += width
        level, width = pair(level[: max(0, len(level) - width)], level[width:]), width * 2
    return out


def _hash_windows(least: int, gram: int):
    """(doc_id, s, hash) of the windows around the places, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, ids, places = one_chunk(b.column(1)), b.column(0).to_numpy(), b.column(2)
            for s, e in slices(text, RUN_BYTES):
                w = Words(text.slice(s, e - s))
                mine = places.slice(s, e - s)
                row = np.repeat(np.arange(e - s), pc.list_value_length(mine).to_numpy(zero_copy_only=False).astype(np.int64))
                first = (mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[:, None] - np.arange(least - gram + 1)).ravel()
                row = np.repeat(row, least - gram + 1)
                ok = (first >= 0) & (w.start[row] + first + least <= w.start[row + 1])
                at, where = np.unique((w.start[row] + first)[ok], return_index=True)
                row, first, h = row[ok][where], first[ok][where], window_hashes(w, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][row], pa.int64()), pa.array(first, pa.int64()), pa.array(h[at].view(np.int64), pa.int64())], ["doc_id", "s", "hash"])

    return run


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, words): maximal stretches of a document's words that other documents have too."""
    spark = docs.sparkSession
    given = docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(given.mapInArrow(_find_anchors(least, gram), "doc_id long, pos int, key long"), "anchors")
    counts = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", (F.col("n") > hot).alias("hot"))
    kept = found.join(counts, "key")
    places = written(kept.groupBy("doc_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("hot") == h, F.col("pos")))).alias(c) for c, h in (("places", False), ("windows", True)))), "places")
    sizes = places.agg(F.sum(F.size("places")), F.sum(F.size("windows"))).first()
    tasks = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-(sizes[0] or 0) // PLACES))
    coded = given.join(places.filter(F.size("places") > 0).select("doc_id", "places"), "doc_id").mapInArrow(_front_code(least, gram, parts), "part int, run binary")
    spans = coded.repartition(tasks, "part").groupBy("part").applyInArrow(_merge(least, gram), "doc_id long, s long, e long")
    if sizes[1]:
        hashed = given.join(places.filter(F.size("windows") > 0).select("doc_id", "windows"), "doc_id").mapInArrow(_hash_windows(least, gram), "doc_id long, s long, hash long")
        again = hashed.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("hash")
        spans = spans.unionByName(hashed.join(again, "hash").select("doc_id", "s", (F.col("s") + least).alias("e")))
    # Join overlapping and touching spans of a document.
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    far = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (far.isNull() | (F.col("s") > far)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("words"))


ORACLE = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(0, len(ws) - {LEAST - 1}), lambda i: md5(array_to_string(ws[i + 1 : i + {LEAST}], ' ')))) AS h,
    unnest(range(0, len(ws) - {LEAST - 1})) AS s FROM w WHERE len(ws) >= {LEAST}
), r AS (
  SELECT DISTINCT doc_id, s FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id))
), b AS (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LEAST} OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM r
), i AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM b
)
SELECT doc_id, min(s) AS start_word, max(s) + {LEAST} AS end_word, max(s) + {LEAST} - min(s) AS words FROM i GROUP BY doc_id, island
"""
