import random

import brute
from helpers import assert_same

from seamark.llm import op3_suffix as op


def got(df):
    return {(r["doc_id"], r["start_word"], r["end_word"]) for r in df.collect()}


def test_whole_table_against_sql(spark, documents, duck):
    assert_same(op.repeated_passages(documents[0]), duck, op.ORACLE)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdef") + rng.choice("äxyz") for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            if rows:
                other = rng.choice(rows)[1].split()
                k = rng.randrange(len(other) + 1)
                w[rng.randrange(len(w) + 1) :] = other[k : k + rng.randrange(60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, gram in ((8, 4), (12, 4), (16, 8)):
        want = brute.windows(rows, least)
        assert want and got(op.repeated_passages(df, least, gram, 3)) == want


def test_cases(spark):
    p = " ".join(f"w{k}" for k in range(60))
    rows = [(1, p), (2, "x " + p), (3, None), (4, ""), (5, "short"), (None, p), (6, f"{p} {p}"), (7, " ".join(f"u{k}" for k in range(60)) + " y " + " ".join(f"u{k}" for k in range(60))), (8, "z " * 200_000), (9, "z " * 100), (2, "x " + p)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pos int, key string")
    assert got(op.repeated_passages(df)) == {(1, 0, 60), (2, 1, 61), (6, 0, 120), (8, 0, 200_000), (9, 0, 100)}


def test_empty_table(spark):
    assert got(op.repeated_passages(spark.createDataFrame([], "doc_id long, text string"))) == set()


def test_merge_is_the_sorted_order():
    rng = random.Random(2)
    every, runs = [], []
    for _ in range(7):
        own = sorted([rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(0, 20)))
        every += own
        shared = [0, *(op.prefix(a, b, 0) for a, b in zip(own, own[1:]))]
        runs.append((shared if own else [], None, None, [" ".join(w[n:]) for n, w in zip(shared, own)]))
    out, last = [], []
    for run, _, known, size in op.merge_runs([r for r in runs if r[3]]):
        out.append((known, size))
    every.sort()
    want = []
    for w in every:
        want.append((op.prefix(last, w, 0), len(w)))
        last = w
    assert out == want


def test_hot_grams_are_checked_by_windows(spark, documents):
    df, rows = documents
    want = brute.windows([r[:2] for r in rows if r[0] is not None and r[1]], 50)
    for hot in (0, 3):  # all grams are hot, or some
        assert {tuple(r)[:3] for r in op.repeated_passages(df, hot=hot).collect()} == want
