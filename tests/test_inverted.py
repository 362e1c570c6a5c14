from collections import Counter

from pyspark.sql import functions as F

from seamark import store
from seamark.functions import inverted


def test_lists_hold_every_word_of_every_row(spark, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_WORDS", 1_000_000)
    texts = [(k, [f"w{(k * 7) % 11}", "é", "w1"] * (k % 4), ["w1", f"x{k}"] * (k % 3)) for k in range(400)] + [(400, [], []), (401, ["long"] * 5000, [])]
    df = spark.createDataFrame(texts, "id long, a array<string>, b array<string>").repartition(3)
    rows = inverted.invert(df, "word", {"a": 5, "b": 1}).select("bucket", "word", "occurrences", F.inline("hits")).collect()
    want = Counter()
    for k, a, b in texts:
        for words, weight in ((a, 5), (b, 1)):
            for w in words:
                want[w, k] += weight
    assert Counter({(r["word"], r["id"]): r["weight"] for r in rows}) == want and len(rows) == len(want)
    assert all(r["bucket"] == inverted.bucket_of(r["word"]) for r in rows)
    assert {r["b"] for r in spark.createDataFrame([("é",)], "x string").select(inverted.bucket(F.col("x")).alias("b")).collect()} == {inverted.bucket_of("é")}


def test_building_the_index_neither_shuffles_nor_sorts_postings(spark):
    """The postings went through two shuffles and a sort, which spilled at 1 GB."""
    chunks = spark.createDataFrame([(k, 1, 0, 0, "Red house", "a red car " * k) for k in range(50)], "element_id long, site_id int, section_id int, chunk int, title string, body string")
    from seamark.operators import lexical

    plan = lexical.posting_lists(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    before = spark.conf.get("spark.sql.optimizer.plannedWrite.enabled")
    ix = store.build(chunks)
    assert spark.conf.get("spark.sql.optimizer.plannedWrite.enabled") == before
    found = store.matching(ix.postings, "lexeme", ["red"]).collect()
    assert {(r["element_id"], r["fifths"]) for r in found} == {(k, 5 + k) for k in range(50)} and len(found) == 50
    assert {r["term"] for r in store.matching(ix.grams, "gram", ["red"]).collect()} == {"red"}
    assert store.matching(ix.grams, "gram", []).count() == 0
