import time

import brute
from helpers import assert_same

from seamark.llm import op8_lines as op


def check(df, rows, share, least):
    got = sorted(((r["doc_id"], r["text"], r[-1]) for r in op.dedup_lines(df, share, least).collect()), key=repr)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute.dedup_lines([r[:2] for r in rows], share, least))), key=repr)


def test_whole_table(spark, documents, duck):
    df, rows = documents
    assert_same(op.dedup_lines(df.select("doc_id", "text")), duck, op.ORACLE)
    check(df, rows, 0.0, 1)  # a low threshold, so that many lines go


def test_cases(spark):
    rows = [
        (1, "Head\nbody one\n\nfoot"), (2, "HEAD \n\tbody  two\nfoot\n"), (3, "head\nfoot"), (4, None), (5, ""), (6, "\n\n"), (None, "head\nnull doc"), (None, "head\nnull doc"), (7, "foot\r\nx"), (7, "foot\r\nx"), (7, "again\nagain\nagain"),
        (8, "line\n" * 30_000 + "head"), (9, "x" * 500_000),
    ]
    df = spark.createDataFrame([(*r, 1, "k", "h") for r in rows], "doc_id long, text string, dropped_lines int, seamark_key string, line_hash string")
    for share, least in ((0.0, 1), (0.0, 3), (0.3, 1), (0.9, 1)):
        check(df, rows, share, least)
    out = op.dedup_lines(df)
    assert out.columns == [*df.columns, "_dropped_lines"]
    assert op.dedup_lines(df.limit(0)).count() == 0


def test_threshold_follows_the_corpus(spark):
    rows = [(k, f"header {k % 10}\nown {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, 0.05, 1)
    check(df, rows, 0.1, 1)  # exactly at the threshold: kept
    assert {r["text"].startswith("own") for r in op.dedup_lines(df, 0.05, 1).collect()} == {True}


def test_default_threshold_is_the_same_at_every_size(spark):
    for n in (50, 6000):
        rows = [(k, f"own {k}" + ("\nmenu of one site" if k < 11 else "\nrare" if k < 21 else "")) for k in range(n)]
        got = {r["doc_id"]: r["text"] for r in op.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {k: t.replace("\nmenu of one site", "") for k, t in rows}  # 11 documents: dropped; 10: kept


def test_many_frequent_lines_in_one_text(spark):
    """The cut is linear: a text of 60,000 frequent lines takes seconds."""
    shared = "\n".join(f"line {k}" for k in range(60_000))
    rows = [(k, f"own {k}\n{shared}\nend {k}") for k in range(3)]
    began = time.time()
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 0.0, 2)
    assert time.time() - began < 60
