"""Document fingerprints by content-defined chunking.

A gear hash over the bytes of the lower-case text sets chunk bounds where its high bits are zero: more bits before the normal chunk
length, fewer after it (normalised chunking), so lengths cluster and a change in one place moves no bound elsewhere. A document's
fingerprint is the set of its chunks' digests; a digest carries its chunk's length, which is its weight. The containment of A in B is the
weight of the digests that they share over the weight of A's.

The result has one row a document: its class (the documents that links and equal sets connect, named by the smallest id), the number of other texts that hold at
least `threshold` of it, the number of other texts of which it holds as much, and of its exact copies. No pair leaves the task that finds it, so what
is sent and returned grows with the documents, not with the pairs of a group of near copies.

How links are found, all of them: digests that only one set has never leave the counting step. A set looks for others by its rarest digests only, down to where what
remains weighs less than the threshold asks for; a set that holds enough of it has one of those. A digest's family is the smallest set that has it. Sets
meet by family: near copies share nearly all families, so a set is sent a few times, with its shared digests, and two sets are measured in whole in the first
family in which they meet. Large families are cut into blocks of sets, each pair of blocks is a task's work. Digests that a bounded sample (`HOT_SAMPLE` documents) shows to be
frequent are counted by partial aggregation, so no digest, however frequent, comes together in one task.

Defined results: null and empty texts have no chunks and no row; rows with a null doc_id, or one that isn't a whole number, are left out; equal rows count once; rows with
one doc_id and different texts are one document: its classes are one, its numbers are added up, but links between its own texts aren't made by containment; ties need no order; other columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, one_chunk, slices, whole, written
from .op2_simhash import Forest, components

LEAST, NORMAL, MOST = 16, 32, 128
STRICT, LOOSE = 6, 4  # bits that are zero before and after the normal length
THRESHOLD = 0.3
#: Digests that HOT_DOCS of at most HOT_SAMPLE sampled documents have are frequent.
HOT_SAMPLE, HOT_DOCS = 20_000, 20
#: Sets to a block of a family; rows worked on at once; pairs expanded at once.
BLOCK, ROWS, PAIRS = 50_000, 20_000, 1 << 21
_LENGTH_BITS = 10
GEAR = (mix(np.arange(1, 257)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 bytes' values, each shifted by its distance. By doubling, as arrays."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def bounds(h: np.ndarray, begin: int, end: int, strict: list[int], loose: list[int]) -> list[int]:
    """Ends of the chunks of bytes begin..end; strict and loose: where the hash allows a bound (after that byte)."""
    out = []
    while end - begin > LEAST:
        k = bisect_left(strict, begin + LEAST)
        at = strict[k] if k < len(strict) else end
        if at >= begin + NORMAL:
            k = bisect_left(loose, begin + NORMAL)
            at = min(loose[k] if k < len(loose) else end, begin + MOST)
        begin = min(at, end)
        out.append(begin)
    if begin < end:
        out.append(end)
    return out


def chunk_ends(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The bytes of the lower-case texts, their offsets, and the ends of each text's chunks."""
    low = pc.utf8_lower(text).cast(pa.binary())
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = []
    # A text's hash must not see the text before it: texts are hashed with 32 zero bytes between.
    gap = 32
    spread = np.zeros(int(offsets[-1] - offsets[0]) + gap * len(text), np.uint8)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    spread[np.arange(len(row)) + gap * (row + 1)] = data[offsets[0] : offsets[-1]]
    h = gear(spread)
    strict_all = np.flatnonzero((h >> np.uint32(32 - STRICT)) == 0) + 1
    loose_all = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0) + 1
    for r in range(len(text)):
        s = int(offsets[r] - offsets[0]) + gap * (r + 1)
        e = s + int(offsets[r + 1] - offsets[r])
        strict = strict_all[np.searchsorted(strict_all, s) : np.searchsorted(strict_all, e, "right")].tolist()
        loose = loose_all[np.searchsorted(loose_all, s) : np.searchsorted(loose_all, e, "right")].tolist()
        ends.append([x - s for x in bounds(h, s, e, strict, loose)])
    return data, offsets, ends


def digests(text: pa.Array) -> list[list[int]]:
    """The sorted set of digests of each text; the low bits of a digest are its chunk's length."""
    data, offsets, ends = chunk_ends(text)
    raw = memoryview(data)
    high, half = (1 << 64) - (1 << _LENGTH_BITS), 1 << 63
    out = []
    for s, mine in zip(offsets.tolist(), ends):
        begin, found = 0, set()
        for e in mine:
            found.add(xxhash.xxh3_64_intdigest(raw[s + begin : s + e]) & high | (e - begin))
            begin = e
        out.append(sorted(x - (1 << 64) if x >= half else x for x in found))
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = one_chunk(b.column(1))
        for s, e in slices(text):
            d = digests(text.slice(s, e - s))
            keep = pa.array([bool(x) for x in d])
            own = [x for x in d if x]
            sets = [np.array(x, np.int64) for x in own]
            name = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
            total = pa.array([int((x & ((1 << _LENGTH_BITS) - 1)).sum()) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).filter(keep), name, pa.array(own, pa.list_(pa.int64())), total], ["doc_id", "set_id", "digests", "total"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, digests, total) of every document with text."""
    given = docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return given.mapInArrow(_prints, "doc_id long, set_id long, digests array<long>, total long")


def _size(x):
    return x.bitwiseAND((1 << _LENGTH_BITS) - 1)


def shared_digests(docs: DataFrame, n: int) -> DataFrame:
    """(set_id, digest, df, fam) of the digests that several sets have: in how many, and their family."""
    each = fingerprints(docs).select("set_id", F.explode("digests").alias("digest"))
    drawn = fingerprints(docs.sample(min(1.0, HOT_SAMPLE / max(1, n)), seed=5)).dropDuplicates(["set_id"]).select(F.explode("digests").alias("digest"))
    hot = written(drawn.groupBy("digest").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT_DOCS).select("digest", F.lit(True).alias("hot")), "hot")
    # Rows of a hot digest are spread by set; all others meet by digest.
    marked = each.join(F.broadcast(hot), "digest", "left").withColumn("spread", F.when(F.col("hot"), F.col("set_id")).otherwise(F.lit(0)))
    here = Window.partitionBy("digest", "spread")
    found = marked.repartition("digest", "spread").distinct().withColumn("df", F.count("*").over(here)).withColumn("fam", F.min("set_id").over(here)).filter("df > 1 OR hot")
    found = written(found.select("set_id", "digest", "df", F.hash("fam").alias("fam"), "hot"), "shared")
    counts = found.filter("hot").groupBy("digest").agg(F.count("*").alias("all"), F.min("set_id").alias("first")).select("digest", "all", F.hash("first").alias("first"))
    # As few as the hot digests, which the sample bounds.
    both = found.join(F.broadcast(counts), "digest", "left")
    return both.select("set_id", "digest", F.coalesce("all", "df").alias("df"), F.coalesce("first", "fam").alias("fam")).filter("df > 1")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length)


def linked(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times contained, times containing) of each row, and links that span their groups, as (a, b) rows, for rows sorted by (fam, i, j), a block of a family each.

    A row is a set: its digests from the most frequent down with their families, from which on it looks for others, and its places (`mine`: as the one that looks, `theirs`: as the one found).
    """
    n = len(t)
    one = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    digest, row = _lists(t.column("d").combine_chunks())
    family, _ = _lists(t.column("f").combine_chunks())
    fam, i, j, before, total = one("fam"), one("i"), one("j"), one("before"), one("total")
    group = np.cumsum(np.concatenate([[0], (np.diff(fam) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
    looks, is_found = one("mine") == i, one("theirs") == j
    least, name = threshold * total, one("rep")
    vocab, word = np.unique(digest, return_inverse=True)
    weight = (vocab & ((1 << _LENGTH_BITS) - 1)).astype(np.float64)
    begin = np.searchsorted(row, np.arange(n + 1))
    probe = np.arange(len(row)) - begin[row] >= before[row]
    # All entries in the order of (row, word), to look words up.
    code = row * len(vocab) + word
    order = np.argsort(code, kind="stable")
    code, probe_of, family_of = code[order], probe[order], family[order]
    here = family == fam[row]
    key = word * (int(group[-1]) + 1) + group[row]
    k = np.flatnonzero(here & is_found[row])
    k = k[np.argsort(key[k], kind="stable")]
    found_key, found_row = key[k], row[k]
    k = np.flatnonzero(here & probe & looks[row])
    lo, hi = np.searchsorted(found_key, key[k], "left"), np.searchsorted(found_key, key[k], "right")
    seek, many = row[k], hi - lo
    out, into = np.zeros(n, np.int64), np.zeros(n, np.int64)
    forest, edges = Forest(n), []
    # By row, so that a pair comes up in one piece of work; a row's partners are cut where they are too many, by the partner.
    ends = np.cumsum(many)
    start = 0
    while start < len(k):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        while stop < len(k) and seek[stop] == seek[stop - 1]:
            stop += 1
        m = many[start:stop]
        b = found_row[np.repeat(lo[start:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        pairs = np.unique(np.repeat(seek[start:stop], m) * n + b)
        a, b = pairs // n, pairs % n
        ok = (a != b) & (total[b] >= least[a]) & (name[a] != name[b])
        a, b = a[ok], b[ok]
        size = begin[b + 1] - begin[b]
        rows_end = np.cumsum(size)
        s = 0
        while s < len(a):
            e = max(s + 1, int(np.searchsorted(rows_end, (rows_end[s - 1] if s else 0) + 4 * PAIRS, "right")))
            z = size[s:e]
            first = np.cumsum(z) - z
            at = np.repeat(begin[b[s:e]], z) + np.arange(z.sum()) - np.repeat(first, z)
            want = np.repeat(a[s:e], z) * len(vocab) + word[at]
            where = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[where] == want
            w = np.add.reduceat(np.where(hit, weight[word[at]], 0.0), first)
            # Measured where they first meet: in the smallest family of the digests by which a looks and that b has.
            meet = np.minimum.reduceat(np.where(hit & probe_of[where], family_of[where], np.iinfo(np.int32).max), first)
            good = np.flatnonzero((w >= least[a[s:e]]) & (meet == fam[a[s:e]]))
            x, y = a[s:e][good], b[s:e][good]
            out += np.bincount(x, minlength=n)
            into += np.bincount(y, minlength=n)
            edges += forest.add(x, y)
            s = e
        start = stop
    return out, into, np.array(edges, np.int64).reshape(-1, 2)


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            out, into, edges = linked(t, threshold)
            sets = t.column("set_id").to_numpy()
            k = np.flatnonzero(out + into)
            none = np.zeros(len(edges), np.int64)
            cols = (np.concatenate([sets[k], sets[edges[:, 0]]]), np.concatenate([sets[k], sets[edges[:, 1]]]), np.concatenate([out[k], none]), np.concatenate([into[k], none]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "inside", "holds"])

        for batch in batches:
            if rows >= ROWS and len(batch):  # work ends where a block ends
                t = pa.Table.from_batches(held)
                last = [t.column(c)[-1].as_py() for c in ("fam", "i", "j")]
                same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(("fam", "i", "j"), last)])
                cut = len(batch) if same.all() else int(np.argmin(same))
                held.append(batch.slice(0, cut))
                rows += cut
                batch = batch.slice(cut)
                if len(batch):
                    yield done(pa.Table.from_batches(held))
                    held, rows = [], 0
            if len(batch):
                held.append(batch)
                rows += len(batch)
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def set_links(docs: DataFrame, sets: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(a, b, inside, holds): numbers of links by set (a = b), and links that span their classes (a <> b)."""
    shared = shared_digests(docs, n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("o"), "digest", "fam")))
    least = F.lit(threshold) * F.col("total")
    before = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n")), lambda s, x: F.struct((s["w"] + _size(x["digest"])).alias("w"), (s["n"] + (s["w"] + _size(x["digest"]) < least).cast("int")).alias("n")))["n"]
    common = shared.groupBy("set_id").agg(ordered.alias("x")).join(sets, "set_id").withColumn("before", before)
    common = written(common.select("set_id", "rep", "total", "before", F.col("x.digest").alias("d"), F.col("x.fam").alias("f")), "common")
    looking = F.array_distinct(F.expr("slice(f, before + 1, size(f))"))
    probing = common.select(F.explode(looking).alias("fam")).groupBy("fam").agg(F.count("*").alias("p"))
    members = common.select("set_id", F.explode(F.array_distinct("f")).alias("fam"))
    size = members.groupBy("fam").agg(F.count("*").alias("m")).filter("m > 1").join(probing, "fam")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    keyed = members.join(size.select("fam", parts("p").alias("sa"), parts("m").alias("sb")), "fam")
    h = F.xxhash64("set_id", F.lit(1))
    rows = keyed.join(common, "set_id").withColumn("mine", F.when(F.array_contains(looking, F.col("fam")), F.pmod(h, F.col("sa"))).otherwise(-1).cast("int")).withColumn("theirs", F.pmod(h, F.col("sb")).cast("int"))
    down = F.when(F.col("mine") >= 0, F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    across = F.transform(F.sequence(F.lit(0), F.col("sa") - 1), lambda i: F.struct(i.alias("i"), F.col("theirs").alias("j")))
    sent = rows.withColumn("at", F.explode(F.array_union(down, across))).select("fam", "at.i", "at.j", "set_id", "rep", "total", "before", "mine", "theirs", "d", "f")
    return sent.repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j").mapInArrow(_links(threshold), "a long, b long, inside long, holds long")


def containment(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, contained_in, contains, copies) of every document with text."""
    # The texts are cut twice: that is cheaper than a table of all digests, of which most belong to one document.
    keys = written(fingerprints(docs).select("doc_id", "set_id", "total").distinct(), "chunks")
    sets = keys.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("total").alias("total"), (F.count("*") - 1).alias("copies"))
    found = written(set_links(docs, sets.drop("copies"), keys.count(), threshold, block), "links")
    several = keys.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.collect_set("set_id").alias("x")).filter(F.size("x") > 1).select(F.explode("x").alias("a"), F.col("low").alias("b"))
    groups = components(found.filter("a <> b").select("a", "b").unionByName(several))
    numbers = found.filter("a = b").groupBy("a").agg(F.sum("inside").alias("inside"), F.sum("holds").alias("holds"))
    known = sets.join(groups, F.col("set_id") == F.col("doc_id"), "left").select("set_id", "rep", "copies", F.coalesce("keeper_id", "set_id").alias("class"))
    classes = known.groupBy("class").agg(F.min("rep").alias("class_id"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by_set = known.join(classes, "class").join(numbers, F.col("set_id") == F.col("a"), "left").select("set_id", "class_id", z("inside").alias("inside"), z("holds").alias("holds"), "copies")
    return keys.join(by_set, "set_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("inside").alias("contained_in"), F.sum("holds").alias("contains"), F.sum("copies").alias("copies"))
