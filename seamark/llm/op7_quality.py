"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text (byte classes, words, repeats, lines, a learned word list) are cut into quantile bins. Boosting goes through the features in turn;
each step fits a shallow tree to one feature's gradient histogram and adds it, shrunk, to that feature's lookup table. Then the pairs
with the greatest gain on the residuals get two-dimensional tables in the same way. A score is the sum of bin lookups, so the
model is a few small arrays, and scoring one pass over the texts.

Two models are learned, for `quality` and for `toxic`. A document is rejected if it is probably of low quality or probably toxic. Fitting uses a bounded sample of labelled rows:
`sample` rows at most, those with the smallest md5 of doc_id, the same at every size; everything else covers all rows. The sample's texts stay on the executors: features
and word counts of them reach the driver (200 bytes a row, and the words that two or more toxic texts of the sample have). The models are fitted as the query is built.

Defined results: null and empty texts are scored as texts without words; null doc_ids (and ids that aren't whole numbers, which have no label) are scored like others; labels that are null, or differ for one doc_id, are left
out of fitting; without labels of both classes a model gives the smoothed share of its positives, or 0.5 (kept, not toxic) without any; equal rows
get equal scores; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, free_name, one_chunk, slices, whole, written

SAMPLE, FOLDS = 20_000, 5
STRIP = ".,;:!?\"'()[]#$%&*|"
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "bar": b"|", "bang": b"!", "symbol": b"#$%&*@^~=+<>{}[]\\/_", "stop": b".,;:?"}
_CLASS = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _k, _b in enumerate(_CLASSES.values()):
    _CLASS[list(_b), _k] = 1
_CLASS[128:, len(_CLASSES)] = 1
FEATURES = (*_CLASSES, "wide", "log_bytes", "log_words", "word_length", "word_spread", "same_as_before", "distinct", "top_word", "line_length", "entropy", "listed", "listed_share")


def features(text: pa.Array, listed: pa.Array | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, len(FEATURES)); listed: lower-case words that the last two features count, each by its weight."""
    n = len(text)
    out = np.zeros((n, len(FEATURES)), np.float64)
    binary = text.cast(pa.binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8) if binary.buffers()[2] is not None else np.zeros(0, np.uint8)
    hist = np.stack([np.bincount(data[s:e], minlength=256) for s, e in zip(offsets[:-1], offsets[1:])]).astype(np.float64)
    size = np.maximum(hist.sum(1), 1)
    out[:, : _CLASS.shape[1]] = hist @ _CLASS / size[:, None]
    at = _CLASS.shape[1]
    w = Words(text, lower=True, strip=STRIP)
    count = np.diff(w.start)
    some = np.maximum(count, 1)
    length = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False).astype(np.float64)[w.ids] if len(w.vocab) else np.zeros(0)
    total = lambda x: np.bincount(w.row, x, n)
    mean = total(length) / some
    spread = np.sqrt(np.maximum(0, total(length**2) / some - mean**2))
    again = np.zeros(len(w.ids))
    again[1:] = (w.ids[1:] == w.ids[:-1]) & (w.row[1:] == w.row[:-1])
    code = np.sort(w.row * max(1, len(w.vocab)) + w.ids)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    row = code[first] // max(1, len(w.vocab))
    top = np.zeros(n)
    if len(first):
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        top[row[begins]] = np.maximum.reduceat(np.diff(first, append=len(code)), begins)
    p = hist / size[:, None]
    entropy = -np.sum(p * np.log2(np.maximum(p, 1e-12)), axis=1)
    hits = np.zeros(n)
    if listed is not None and len(listed) and len(w.vocab):
        at_word = pc.fill_null(pc.index_in(w.vocab, value_set=listed), len(listed)).to_numpy(zero_copy_only=False)
        hits = total(np.append(np.ones(len(listed)) if weights is None else weights, 0.0)[at_word][w.ids])
    lines = hist[:, 10] + 1
    cols = (np.log1p(size), np.log1p(count), mean, spread, total(again) / some, np.bincount(row, minlength=n) / np.sqrt(some), top / some, np.log1p(size / lines), entropy, hits, hits / some)
    out[:, at:] = np.stack(cols, axis=1)
    return out


class Table(NamedTuple):
    """Additive table over the bins of one or two features."""

    of: tuple[int, ...]
    values: np.ndarray


@dataclass
class Additive:
    """Intercept, bin edges by feature, lookup tables."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[Table] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability by row."""
        b = self.bins(x)
        s = np.full(len(x), self.intercept)
        for t in self.tables:
            s += t.values[tuple(b[:, k] for k in t.of)]
        return 1 / (1 + np.exp(-s))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float = 1.0) -> np.ndarray:
    """A tree of this depth over ordered bins with gradient and hessian sums: the step of each bin."""
    out = np.empty(len(g))
    todo = [(0, len(g), depth)]
    while todo:
        s, e, d = todo.pop()
        cg, ch = np.cumsum(g[s:e]), np.cumsum(h[s:e])
        if d and e - s > 1:
            lg, lh = cg[:-1], ch[:-1]
            rg, rh = cg[-1] - lg, ch[-1] - lh
            gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > cg[-1] ** 2 / (ch[-1] + ridge) + 1e-9:
                todo += [(s, s + k + 1, d - 1), (s + k + 1, e, d - 1)]
                continue
        out[s:e] = cg[-1] / (ch[-1] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, least: float = 2.0, edges: list[np.ndarray] | None = None) -> Additive:
    """Cyclic boosting of shallow trees on the logistic loss; then the best pairs on what is left."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    if edges is None:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])] if n else []
    model = Additive(edges, float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    s = np.full(n, model.intercept)
    sizes = [len(e) + 1 for e in edges]
    tables = [np.zeros(m) for m in sizes]
    for _ in range(rounds):
        for k, m in enumerate(sizes):
            if m == 1:
                continue
            p = 1 / (1 + np.exp(-s))
            step = rate * _leaves(np.bincount(b[:, k], y - p, m), np.bincount(b[:, k], p * (1 - p), m), 2, least)
            tables[k] += step
            s += step[b[:, k]]
    model.tables = [Table((k,), t) for k, t in enumerate(tables)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        code = b[:, i] * sizes[j] + b[:, j]
        return (np.bincount(code, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (y - p, p * (1 - p)))

    def tree(i: int, j: int) -> tuple[float, np.ndarray]:
        """One cut of i, then of j on either side; the gain over no tree, and the steps."""
        g, h = cells(i, j)
        rows = _leaves(g.sum(1), h.sum(1), 1, least)
        cut = int(np.argmax(rows != rows[0])) or len(rows)
        out = np.zeros_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            out[part] = _leaves(g[part].sum(0), h[part].sum(0), 1, least)
        return float((out * g).sum()), out

    gains = sorted(((tree(i, j)[0], i, j) for i in range(len(sizes)) for j in range(len(sizes)) if i != j and sizes[i] > 1 and sizes[j] > 1), reverse=True)
    chosen: list[tuple[int, int]] = []
    for _, i, j in gains:
        if (j, i) not in chosen and len(chosen) < pairs:
            chosen.append((i, j))
    grids = [np.zeros((sizes[i], sizes[j])) for i, j in chosen]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(grids, chosen):
            step = rate * tree(i, j)[1]
            t += step
            s += step[b[:, i], b[:, j]]
    model.tables += [Table(ij, t) for ij, t in zip(chosen, grids)]
    return model


class Model(NamedTuple):
    quality: Additive
    toxic: Additive
    listed: list[str]
    weights: np.ndarray

    def score(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        q, t = [np.zeros(0)], [np.zeros(0)]
        listed = pa.array(self.listed, pa.string())
        for s, e in slices(text):
            x = features(text.slice(s, e - s), listed, self.weights)
            q.append(self.quality.score(x))
            t.append(self.toxic.score(x[:, -2:]))
        return np.concatenate(q), np.concatenate(t)


def fold_of(text: pa.Array) -> np.ndarray:
    """Each text's fold, by the text alone."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x) % FOLDS for x in text.cast(pa.binary()).to_pylist()), np.int64, len(text))


def word_counts(text: pa.Array, toxic: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words, and by fold and toxicity the number of texts that have them: (n, 2 * FOLDS)."""
    words, rows, kinds = [], [], (fold_of(text) * 2 + (toxic == 1)).astype(np.int64)
    for s, e in slices(text):
        w = Words(text.slice(s, e - s), lower=True, strip=STRIP)
        if len(w.ids):
            code = np.unique(w.row * len(w.vocab) + w.ids)
            cell = code % len(w.vocab) * (2 * FOLDS) + kinds[s:e][code // len(w.vocab)]
            counts = np.bincount(cell, minlength=len(w.vocab) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
            some = np.flatnonzero(counts.any(1))
            words += w.vocab.take(pa.array(some)).to_pylist()
            rows.append(counts[some])
    return words, np.concatenate([np.zeros((0, 2 * FOLDS), np.int64), *rows])


def significant(words: list[str], a: np.ndarray, b: np.ndarray, na: float, nb: float, rate: float = 0.01, least: int = 2) -> dict[str, float]:
    """Words that a of na toxic texts have, significantly more than the b of nb others (G test, false discovery rate as given), with their log ratio of shares."""
    k = np.flatnonzero(a >= least)  # one text alone proves nothing
    if not len(k) or not nb:
        return {}
    words, a, b = [words[i] for i in k], a[k].astype(float), b[k].astype(float)
    g = np.zeros(len(words))
    for seen, of, everything in ((a, na, a + b), (b, nb, a + b), (na - a, na, na + nb - a - b), (nb - b, nb, na + nb - a - b)):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) * (na + nb) / np.maximum(everything * of, 1e-9)), 0)
    p = np.where(a * nb > b * na, [math.erfc(math.sqrt(max(0.0, x) / 2)) / 2 for x in g], 1.0)
    order = np.lexsort((words, p))
    under = np.flatnonzero(p[order] <= rate * np.arange(1, len(p) + 1) / len(p))
    keep = order[: under[-1] + 1] if len(under) else order[:0]
    return {words[k]: float(np.log((a[k] + 0.5) / (na + 1)) - np.log((b[k] + 0.5) / (nb + 1))) for k in sorted(keep, key=lambda k: words[k])}


def word_lists(words: list[str], counts: np.ndarray, texts: np.ndarray) -> list[dict[str, float]]:
    """The list of each fold's other folds, and last that of all; texts: numbers of texts by fold and toxicity."""
    c, n = counts.reshape(-1, FOLDS, 2), texts.reshape(FOLDS, 2)
    # Each fold's list features come from the list of the other folds, so that they look as they will on new texts.
    use = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    return [significant(words, c[:, f, 1].sum(1), c[:, f, 0].sum(1), float(n[f, 1].sum()), float(n[f, 0].sum())) for f in use]


def listed_features(text: pa.Array, lists: list[dict[str, float]]) -> np.ndarray:
    """(n, 2): the last two features, each text by the list of its fold."""
    out, fold = np.zeros((len(text), 2)), fold_of(text)
    for k in np.unique(fold):
        mine = text.filter(pa.array(fold == k))
        words, weights = pa.array(lists[k], pa.string()), np.array(list(lists[k].values()), np.float64)
        out[fold == k] = np.concatenate([features(mine.slice(s, e - s), words, weights)[:, -2:] for s, e in slices(mine)])
    return out


def plain_features(text: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(features(text.slice(s, e - s)) for s, e in slices(text))])


def fitted(plain: np.ndarray, only: np.ndarray, quality: np.ndarray, toxic: np.ndarray, everything: dict[str, float]) -> Model:
    """Quality doesn't look at the list; toxicity looks at nothing else: form and language are no sign of it."""
    # Few texts have listed words: bins are cut among those, however few, and few may make a leaf.
    some = only > 0
    edges = [np.unique(np.quantile(only[some[:, k], k], np.linspace(0, 1, 65)[:-1])) if some[:, k].any() else np.zeros(0) for k in range(2)]
    return Model(fit(plain, quality), fit(only, toxic, least=0.02, edges=edges), list(everything), np.array(list(everything.values()), np.float64))


NONE = Model(Additive([], 0.0), Additive([], 0.0), [], np.zeros(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(m, text, quality, toxic) of at most `sample` labelled texts, those with the smallest md5 of doc_id; of copies, the first."""
    clear = labels.groupBy(whole("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("q2"), F.min("toxic").alias("toxic"), F.max("toxic").alias("t2"))
    clear = clear.filter("label_id IS NOT NULL AND quality = q2 AND toxic = t2").select("label_id", "quality", "toxic", F.md5(F.col("label_id").cast("string")).alias("m")).orderBy("m", "label_id").limit(sample)
    rows = docs.select(whole("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(clear), F.col("doc_id") == F.col("label_id"))
    first = rows.groupBy("text").agg(F.min(F.struct("m", "quality", "toxic")).alias("x"))
    return first.select("x.m", "text", F.col("x.quality").cast("int").alias("quality"), F.col("x.toxic").cast("int").alias("toxic"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = one_chunk(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(plain_features(text)), pa.list_(pa.float64())), b.column(2), b.column(3), pa.array(fold_of(text))], ["m", "x", "quality", "toxic", "fold"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, counts = word_counts(one_chunk(b.column(1)), b.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(counts[:, k]) for k in range(2 * FOLDS))], ["word", *(f"c{k}" for k in range(2 * FOLDS))])


def _list(lists: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(listed_features(one_chunk(b.column(1)), lists)), pa.list_(pa.float64()))], ["m", "x"])

    return run


def train(sample: DataFrame) -> Model:
    """From labelled_sample(): the texts are measured where they are."""
    few = written(sample, "sample")
    rows = sorted(few.mapInArrow(_measure, "m string, x array<double>, quality int, toxic int, fold long").collect())
    if not rows:
        return NONE
    plain, quality, toxic, fold = (np.array([r[k] for r in rows], np.float64) for k in (1, 2, 3, 4))
    texts = np.bincount((fold * 2 + (toxic == 1)).astype(np.int64), minlength=2 * FOLDS)
    names = [f"c{k}" for k in range(2 * FOLDS)]
    counted = few.mapInArrow(_count, ", ".join(["word string", *(f"{c} long" for c in names)])).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))
    found = sorted(counted.filter(F.expr(" + ".join(names[1::2])) >= 2).collect())
    lists = word_lists([r[0] for r in found], np.array([r[1:] for r in found], np.int64).reshape(-1, 2 * FOLDS), texts)
    only = np.array([r[1] for r in sorted(few.mapInArrow(_list(lists), "m string, x array<double>").collect())]).reshape(-1, 2)
    return fitted(plain, only, quality, toxic, lists[-1])


def train_local(rows: list[tuple]) -> Model:
    """The same from rows (m, text, quality, toxic) that lie here."""
    if not rows:
        return NONE
    text = pa.array([r[1] for r in rows], pa.string())
    quality, toxic = (np.array([r[k] for r in rows], np.float64) for k in (2, 3))
    words, counts = word_counts(text, toxic)
    by: dict[str, np.ndarray] = {}
    for x, c in zip(words, counts):
        by[x] = by[x] + c if x in by else c
    lists = word_lists(list(by), np.array(list(by.values()), np.int64).reshape(-1, 2 * FOLDS), np.bincount(fold_of(text) * 2 + (toxic == 1), minlength=2 * FOLDS))
    return fitted(plain_features(text), listed_features(text, lists), quality, toxic, lists[-1])


def scorer(model: Model):
    kind = T.StructType([T.StructField("quality", T.DoubleType()), T.StructField("toxic", T.DoubleType())])

    @F.arrow_udf(kind)
    def score(text: pa.Array) -> pa.Array:
        q, t = model.score(one_chunk(text))
        return pa.StructArray.from_arrays([pa.array(q), pa.array(t)], ["quality", "toxic"])

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with quality_score, toxic_score, and keep: quality of at least 0.5, toxic of at most 0.5."""
    score = scorer(train(labelled_sample(docs, labels, sample)))
    s, q, t, k = (free_name(docs, c) for c in ("seamark_scores", "quality_score", "toxic_score", "keep"))
    scored = docs.withColumn(s, score(F.col("text").cast("string")))
    scored = scored.withColumn(q, F.round(F.col(f"{s}.quality"), 6)).withColumn(t, F.round(F.col(f"{s}.toxic"), 6)).drop(s)
    return scored.withColumn(k, (F.col(q) >= 0.5) & (F.col(t) <= 0.5))
