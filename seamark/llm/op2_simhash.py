"""SimHash near-duplicate detection by a binary-trie self-join.

Every document gets a 64-bit SimHash over its words (weight: square root of the count) for the search, and a 128-bit
SimHash over word pairs to confirm what the search finds. Two documents are near copies if the first differ in at most
`search_bits` and the second in at most `confirm_bits`; groups are the connected components, the smallest doc_id stays.

The search is exact: `search_bits` errors over three blocks of bits leave one block with at most a third of them, so
three tries, each with another block in front, are joined with themselves. Node pairs descend together, add the bits in
which they differ, and are dropped when the block's budget is exceeded; what reaches the end of the block is compared in
all bits. A trie is cut at a depth at which a subtree holds about `subtree` fingerprints; each pair of subtrees within
budget is one task, in which node pairs advance as arrays. Each task returns a spanning forest of its pairs, so a
group of thousands of copies yields thousands of edges, not millions.

What is sent: a fingerprint goes once for each block and each subtree within that block's budget. A subtree holds up to 2^20 fingerprints (32 bytes
each), so 14 million of them (30 GB of text) make 45 copies each, 30 million 78; the number of tasks follows, and none holds more than two subtrees' worth,
as bits are taken in the order of how evenly they are set.

Defined results: null and empty texts, and texts without words, are equal to nothing and never grouped; near_duplicates() leaves out rows with a null doc_id
(or one that isn't a whole number), drop_near_duplicates() judges them by their text: such a row goes if its text's group has
another document, and of such rows of one text one stays (ids of 2^62 and more should not be in use there); rows with one doc_id and several texts
are one document, in the group of each of its texts; equal texts always fall together; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, forget, free_name, mix, one_chunk, pair, slices, whole, written

PUNCTUATION = ".,;:!?\"'()[]{}<>|#$%&*-_"
SEARCH_BITS, CONFIRM_BITS, SUBTREE, BLOCKS = 11, 34, 1 << 20, 3
#: Subtrees of each trie, as a power of 2, at least: so many tasks there are at any size.
LEAST_CUT = 2
#: Word weights are whole numbers, so that sums are exact in any order.
WEIGHT = 64
_BITS = np.array([[(i >> (7 - j)) & 1 for j in range(8)] for i in range(256)], np.float32) * 2 - 1


def _signs(h: np.ndarray) -> np.ndarray:
    """(n,) hashes to (n, 64) of +1 and -1."""
    return _BITS[h.astype(">u8").view(np.uint8)].reshape(len(h), 64)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).reshape(len(sums), -1, 8).view(">u8")[..., 0].astype(U64)


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) words of 64 bits, and the number of words of each text."""
    w = Words(text, lower=True, strip=PUNCTUATION)
    n = len(text)
    counts = np.diff(w.start)
    one = np.zeros((n, 64), np.float64)
    two = np.zeros((n, 128), np.float64)
    signs = _signs(w.vocab_hash) if len(w.vocab_hash) else np.zeros((0, 64), np.float32)
    code = w.row * max(1, len(w.vocab_hash)) + w.ids
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    tally = np.rint(WEIGHT * np.sqrt(np.diff(first, append=len(code)))).astype(np.float32)
    uniq = code[first]
    uid = uniq % max(1, len(w.vocab_hash))
    bounds = np.searchsorted(uniq // max(1, len(w.vocab_hash)), np.arange(n + 1))
    both = pair(w.hashes[:-1], w.hashes[1:]) if len(w.hashes) > 1 else np.zeros(0, U64)
    step = 1 << 12  # sums of so many stay exact in single precision
    for r in range(n):
        for s in range(bounds[r], bounds[r + 1], step):
            e = min(s + step, bounds[r + 1])
            one[r] += tally[s:e] @ signs[uid[s:e]]
        lo, hi = w.start[r], w.start[r + 1] - 1
        if hi <= lo:  # a single word
            h = mix(w.hashes[lo : hi + 1])
            two[r] += np.concatenate([_signs(h), _signs(mix(h + U64(1)))], axis=1).sum(0)
        for s in range(lo, hi, step):
            h = both[s : min(s + step, hi)]
            ones = np.ones(len(h), np.float32)
            two[r, :64] += ones @ _signs(h)
            two[r, 64:] += ones @ _signs(mix(h + U64(1)))
    return np.concatenate([_pack(one), _pack(two)], axis=1), counts


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = one_chunk(b.column(1))
        for s, e in slices(text):
            f, n = fingerprints(text.slice(s, e - s))
            keep = n > 0
            ids = b.column(0).slice(s, e - s).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(f[keep, k].view(np.int64)) for k in range(3))], ["doc_id", "f", "g", "h"])


def _descend(a: np.ndarray, b: np.ndarray | None, start: int, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the sorted arrays a and b (b None: a with itself) whose bits start..depth, from the highest, differ in at most budget.

    a and b each hold one subtree: their first `start` bits are constant; the bits in which those differ are already off the budget.
    """

    def trie(x: np.ndarray) -> list:
        levels = []
        nodes = np.array([0, len(x)])  # bounds of the nodes of a level
        for d in range(start, depth):
            cut = np.unique(np.concatenate([nodes, np.flatnonzero(np.diff(x >> U64(63 - d))) + 1]))
            at = np.searchsorted(cut, nodes[:-1])  # the first child of each node
            bit = ((x[cut[:-1]] >> U64(63 - d)) & U64(1)).astype(np.int64)
            size = np.diff(np.append(at, len(cut) - 1))
            zero = np.where(bit[at] == 0, at, -1)
            one = np.where(bit[at] == 1, at, np.where(size == 2, at + 1, -1))
            levels.append(np.stack([zero, one]).astype(np.int32))
            nodes = cut
        return [*levels, nodes]

    same = b is None
    ta = trie(a)
    tb = ta if same else trie(b)
    zero = np.zeros(1, np.int32)
    stack = [(0, zero, zero, np.zeros(1, np.int8))]
    limit = 1 << 20
    last = depth - start
    while stack:
        level, u, v, err = stack.pop()
        if len(u) > limit and level < last:
            half = len(u) // 2
            stack += [(level, u[half:], v[half:], err[half:]), (level, u[:half], v[:half], err[:half])]
            continue
        if level == last:
            yield from _leaves(ta[last], tb[last], u, v, same)
            continue
        cu, cv = ta[level], tb[level]
        parts = []
        within = err < budget
        for i in (0, 1):
            ui = cu[i][u]
            for j in (0, 1):
                ok = ui >= 0
                if i != j:
                    ok &= within
                    if same and i == 1:
                        ok &= u != v  # the mirror image of (0, 1)
                vj = cv[j][v]
                ok &= vj >= 0
                k = np.flatnonzero(ok)
                if len(k):
                    parts.append((ui[k], vj[k], err[k] + np.int8(i != j)))
        if parts:
            stack.append((level + 1, *(np.concatenate([p[c] for p in parts]) for c in range(3))))


def _leaves(na: np.ndarray, nb: np.ndarray, u: np.ndarray, v: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    su, sv = na[u + 1] - na[u], nb[v + 1] - nb[v]
    total = su * sv
    ends = np.cumsum(total)
    start = 0
    while start < len(u):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + (1 << 21), "right")))
        t = total[start:end]
        if end - start == 1 and t[0] > 1 << 22:  # one large pair of nodes: by rows
            cols = np.arange(nb[v[start]], nb[v[start] + 1])
            for i in range(na[u[start]], na[u[start] + 1]):
                js = cols[cols > i] if same and u[start] == v[start] else cols
                yield np.full(len(js), i), js
        else:
            w = np.repeat(np.arange(start, end), t)
            k = np.arange(len(w)) - np.repeat(np.cumsum(t) - t, t)
            i, j = na[u[w]] + k // sv[w], nb[v[w]] + k % sv[w]
            if same:
                ok = (i < j) | (u[w] != v[w])
                i, j = i[ok], j[ok]
            yield i, j
        start = end


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join two trees so far apart."""
        out = []
        for _ in range(8):  # most pairs are within one tree: drop them as arrays
            self.up = self.up[self.up]
        k = np.flatnonzero(self.up[i] != self.up[j])
        for a, b in zip(i[k].tolist(), j[k].tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _join_task(order: list[list[int]], cut: int, lengths: list[int], search: int, confirm: int):
    """applyInArrow function: rows (task, side, f, g, h, doc_id) of one pair of subtrees to edges."""

    def join(t: pa.Table) -> pa.Table:
        task = t.column("task")[0].as_py()
        block = task >> 40
        col = {c: t.column(c).to_numpy() for c in ("side", "f", "g", "h", "doc_id")}
        f = col["f"].view(U64)
        p = np.zeros(len(f), U64)
        for at, bit in enumerate(order[block]):
            p |= ((f >> U64(63 - bit)) & U64(1)) << U64(63 - at)
        rank = np.lexsort((col["doc_id"], p))
        p, side = p[rank], col["side"][rank]
        g, h, ids = col["g"].view(U64)[rank], col["h"].view(U64)[rank], col["doc_id"][rank]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = (task >> 20) & 0xFFFFF == task & 0xFFFFF
        used = bin(((task >> 20) & 0xFFFFF) ^ (task & 0xFFFFF)).count("1")
        out: list[tuple[int, int]] = []
        if len(left) and (same or len(right)):
            forest = Forest(len(p))
            for i, j in _descend(p[left], None if same else p[right], cut, lengths[block], search // BLOCKS - used):
                i, j = left[i], (left if same else right)[j]
                k = np.flatnonzero(np.bitwise_count(p[i] ^ p[j]) <= search)
                i, j = i[k], j[k]
                k = np.flatnonzero(np.bitwise_count(g[i] ^ g[j]).astype(np.int32) + np.bitwise_count(h[i] ^ h[j]) <= confirm)
                if len(k):
                    out += forest.add(i[k], j[k])
        e = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[e[:, 0]], pa.int64()), "b": pa.array(ids[e[:, 1]], pa.int64())})

    return join


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(doc_id, keeper_id): the smallest id of each connected component for its other members, by alternating large and small stars.

    Each round is two aggregations over the edges, which shrink to stars in O(log^2 n) rounds; every round is a written table.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("keeper_id"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        forget(edges)
        edges = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, search_bits: int = SEARCH_BITS, confirm_bits: int = CONFIRM_BITS, subtree: int = SUBTREE, least_cut: int = LEAST_CUT) -> DataFrame:
    """(doc_id, keeper_id) for every document that goes; keeper_id is the document of its group that stays."""
    given = docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return _groups(given, search_bits, confirm_bits, subtree, least_cut)


def _groups(given: DataFrame, search_bits: int = SEARCH_BITS, confirm_bits: int = CONFIRM_BITS, subtree: int = SUBTREE, least_cut: int = LEAST_CUT) -> DataFrame:
    prints = written(given.mapInArrow(_fingerprint_batches, "doc_id long, f long, g long, h long"), "fingerprints")
    nodes = written(prints.groupBy("f", "g", "h").agg(F.min("doc_id").alias("rep")), "nodes")
    shares = nodes.agg(F.count("*").alias("n"), *(F.sum(F.expr(f"shiftrightunsigned(f, {63 - b}) & 1")).alias(f"b{b}") for b in range(64))).first()
    n = shares["n"]
    equal = prints.join(nodes, ["f", "g", "h"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if n < 2:
        return components(equal)
    # The most evenly set bits come first in each block, so that subtrees are of like size.
    even = sorted(range(64), key=lambda b: abs(shares[f"b{b}"] / n - 0.5))
    blocks = [even[k::BLOCKS] for k in range(BLOCKS)]
    order = [b + [x for x in even if x not in b] for b in blocks]
    cut = max(least_cut, min(18, math.ceil(math.log2(n / subtree))))
    most = search_bits // BLOCKS
    sent = []
    for k, bits in enumerate(order):
        top = F.lit(0).cast("long")
        for at in range(cut):
            top = top.bitwiseOR(F.shiftleft(F.expr(f"shiftrightunsigned(f, {63 - bits[at]}) & 1"), cut - 1 - at))
        # Subtrees within the budget of this one: flip at most `most` of its first bits.
        masks = [m for m in range(1 << cut) if bin(m).count("1") <= most]
        other = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
        x = nodes.select("f", "g", "h", F.col("rep").alias("doc_id"), top.alias("top")).select("*", other.alias("mask"))
        y = x.withColumn("other", F.col("top").bitwiseXOR(F.col("mask")))
        low, high = F.least("top", "other"), F.greatest("top", "other")
        sent.append(y.select((F.lit(k << 40) + F.shiftleft(low, 20) + high).alias("task"), F.when(F.col("top") == low, 0).otherwise(1).alias("side"), "f", "g", "h", "doc_id"))
    work = sent[0]
    for s in sent[1:]:
        work = work.unionByName(s)
    tasks = BLOCKS * (1 << cut) * len(masks)
    lengths = [len(b) for b in blocks]
    near = work.repartition(max(12, min(tasks, 20000)), "task").groupBy("task").applyInArrow(_join_task(order, cut, lengths, search_bits, confirm_bits), "a long, b long")
    return components(near.unionByName(equal))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each group. Rows without text or words stay; rows without doc_id are judged by their text."""
    key, gone_key = free_name(docs, "seamark_id"), free_name(docs, "seamark_gone")
    by_text = F.lit(1 << 62) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    named = docs.withColumn(key, F.coalesce(whole("doc_id"), by_text))
    given = named.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    gone = _groups(given, **parameters).select(F.col("doc_id").alias(gone_key))
    has_id, no_text = whole("doc_id").isNotNull(), F.coalesce(F.trim(F.col("text").cast("string")), F.lit("")) == ""
    kept = named.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    # Rows without an id and of one text: partial aggregation leaves one in each task before any is sent.
    return kept.filter(has_id | no_text).unionByName(kept.filter(~has_id & ~no_text).dropDuplicates([key])).select(*(f"`{c}`" for c in docs.columns))
