import random

import brute
import numpy as np
import pyarrow as pa

from seamark.llm import op5_chunks as op


def got(df):
    return {tuple(r) for r in df.collect()}


def test_whole_table_against_brute_force(spark, documents):
    df, rows = documents
    want = brute.containment([r[:2] for r in rows], op.THRESHOLD)
    assert want and got(op.containment(df)) == want


def gear_plain(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(op.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    assert op.gear(data).tolist() == gear_plain(data.tolist())


def test_chunks_cover_the_text_and_keep_their_limits():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh äöü\n") for _ in range(n)) for n in (0, 1, 31, 32, 33, 500, 20_000)]
    _, offsets, ends = op.chunk_ends(pa.array(texts))
    for t, e in zip(texts, ends):
        n = len(t.lower().encode())
        assert (e[-1] if e else 0) == n
        sizes = np.diff([0, *e])
        assert all(sizes[:-1] >= op.LEAST) and all(sizes <= op.MOST)


def test_a_change_moves_few_bounds():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    a, b = (set(x) for x in op.digests(pa.array([t, "inserted " + t[:9000] + "!" + t[9000:]])))
    assert len(a & b) > 0.9 * len(a)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50, 3000))) for _ in range(30)]
    rows = [(k, rng.choice(base)[: rng.randrange(1, 3000)] + rng.choice(["", rng.choice(base)[:400]])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, block in ((0.3, op.BLOCK), (0.6, 7), (1.0, 3)):
        assert got(op.containment(df, threshold, block)) == brute.containment(rows, threshold)


def test_work_in_small_pieces_and_with_frequent_digests(spark, monkeypatch):
    """Few rows at a time, few pairs at a time, and digests that count as frequent: the same result."""
    rng = random.Random(6)
    head = "".join(rng.choice("abcdefgh ") for _ in range(200))
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(6)]
    rows = [(k, head + rng.choice(base)[: rng.randrange(100, 600)] + f" {k} ") for k in range(120)] + [(500 + k, head) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.containment(rows, 0.3)
    monkeypatch.setattr(op, "HOT_DOCS", 5)
    monkeypatch.setattr(op, "ROWS", 10)
    monkeypatch.setattr(op, "PAIRS", 16)
    assert got(op.containment(df, 0.3, 20)) == want
    t = pa.table({"set_id": [1, 2], "rep": [1, 2], "total": [64, 64], "before": pa.array([0, 0], pa.int32()), "d": [[64], [64]], "f": pa.array([[7], [7]], pa.list_(pa.int32())), "fam": pa.array([7, 7], pa.int32()), "i": pa.array([0, 0], pa.int32()), "j": pa.array([0, 0], pa.int32()), "mine": pa.array([0, 0], pa.int32()), "theirs": pa.array([0, 0], pa.int32())})
    out, into, edges = op.linked(t, 0.5)
    assert out.tolist() == into.tolist() == [1, 1] and len(edges) == 1


def test_cases(spark):
    long = "abcdefghij klm " * 40_000 + "".join(random.Random(7).choice("abcdefgh ") for _ in range(9000))
    rows = [(3, "Same text"), (2, "same text"), (2, "same text"), (None, "same text"), (5, None), (6, ""), (7, None), (8, long), (9, long + "tail"), (4, "one text"), (4, "one text and more of it")]
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, set_id int, digest string, total double")
    found = got(op.containment(df))
    assert found == brute.containment(rows, op.THRESHOLD)
    by = {r[0]: r[1:] for r in found}
    assert by[3][:1] == by[2][:1] == (2,) and by[3][3] == by[2][3] == 1 and by[8][0] == by[9][0] == 8 and set(by) == {2, 3, 4, 8, 9}
    assert got(op.containment(df.limit(0))) == set()


def test_recall_of_near_copies_with_scattered_edits(spark):
    """Against word triples: unequal texts with a Jaccard index of 0.6 or more, one word in 12 to 30 changed."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    rows = []
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 600))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(rng.choice(vocab) if rng.random() < 1 / rng.randrange(12, 31) else w for w in base))]
    triples = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    want = {(i, j) for i in range(len(rows)) for j in range(i) if len(triples[i] & triples[j]) >= 0.6 * len(triples[i] | triples[j]) and rows[i][1] != rows[j][1]}
    found = {r[0]: r[1] for r in got(op.containment(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert len(want) > 30 and sum(found[i] == found[j] for i, j in want) >= 0.9 * len(want)
