import brute
import numpy as np

from seamark.llm import op2_simhash as op


def got(df):
    return {r["doc_id"]: r["keeper_id"] for r in df.collect()}


def test_whole_table_against_brute_force(spark, documents):
    df, rows = documents
    want = brute.near_duplicates([r[:2] for r in rows])
    assert want and got(op.near_duplicates(df)) == want
    for least_cut in (0, 4):
        assert got(op.near_duplicates(df, subtree=20, least_cut=least_cut)) == want  # many subtrees, fewer and more
    assert got(op.near_duplicates(df, least_cut=0)) == want


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = np.sort(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(40, 64, 400).astype(np.uint64)) for _ in range(3))]))
    far = np.bitwise_count((x[:, None] ^ x) >> np.uint64(40))
    for budget in (0, 1, 3):
        found = {(min(i, j), max(i, j)) for a, b in op._descend(x, None, 0, 24, budget) for i, j in zip(a.tolist(), b.tolist())}
        assert found == {(i, j) for i, j in zip(*np.nonzero(far <= budget)) if i < j}


def test_cases(spark):
    long = "one two three four five six " * 30_000
    rows = [(5, "a b c d"), (3, "A b, c d."), (3, "a b c d"), (None, "a b c d"), (7, None), (8, ""), (9, " .. "), (10, None), (11, long), (12, long + "x"), (13, ""), (5, "a b c d"), (20, "w"), (21, "w")]
    df = spark.createDataFrame([(*r, 1, 2, "f") for r in rows], "doc_id long, text string, f int, task int, keeper_id string")
    assert got(op.near_duplicates(df)) == {5: 3, 12: 11, 21: 20}
    kept = op.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # The row without an id has the text of document 3.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "3", "7", "8", "9", "10", "11", "13", "20"])


def test_rows_without_id_are_judged_by_their_text(spark):
    rows = [(None, "alone here now"), (None, "alone here now"), (None, "some words of a text"), (4, "some words of a text"), (None, ""), (None, ""), (None, None)]
    kept = op.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([(None, "alone here now"), (4, "some words of a text"), (None, ""), (None, ""), (None, None)], key=repr)


def test_ids_of_64_bits_and_ids_that_are_no_numbers(spark):
    big = [9_200_000_000_000_000_000 + k for k in range(3)]
    df = spark.createDataFrame([(i, "one two three") for i in big], "doc_id long, text string")
    assert got(op.near_duplicates(df)) == {big[1]: big[0], big[2]: big[0]}
    edges = spark.createDataFrame([(big[0], big[1]), (big[1], big[2])], "a long, b long")
    assert got(op.components(edges)) == {big[1]: big[0], big[2]: big[0]}
    named = spark.createDataFrame([("a", "one two three"), ("7", "one two three"), ("9", "one two three")], "doc_id string, text string")
    assert got(op.near_duplicates(named)) == {9: 7}
    assert [r["doc_id"] for r in op.drop_near_duplicates(named).collect()] == ["7"]


def test_one_document_with_two_texts_joins_their_groups(spark):
    df = spark.createDataFrame([(1, "q w e r t y"), (2, "q w e r t y"), (2, "zz xx cc vv"), (9, "zz xx cc vv")], "doc_id long, text string")
    assert got(op.near_duplicates(df)) == {2: 1, 9: 1}


def test_empty_table(spark):
    assert got(op.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == {}
    assert got(op.near_duplicates(spark.createDataFrame([(1, "x y")], "doc_id long, text string"))) == {}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 101)], "a long, b long")
    assert got(op.components(edges)) == {**{k: 0 for k in range(1, 61)}, 200: 101}
