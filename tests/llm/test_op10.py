import brute
import pyarrow as pa

from seamark.llm import op10_decontaminate as op


def got(df):
    return {tuple(r) for r in df.collect()}


def test_whole_table_against_brute_force(spark, documents, small):
    df, rows = documents
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute.contamination([r[:2] for r in rows], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want and got(op.contamination(df, items)) == want
    assert got(op.contamination(df, items, most_chars=500)) == want  # many automata


ITEMS = [(1, "What is the tallest mountain of the whole wide world, seen from its base? Mauna Kea."), (2, "Short answer: 42!"), (3, None), (4, ""), (5, "?!"), (None, "null item words here"), (2, "Short answer: 42!"), (6, "aa bb cc dd ee ff gg hh ii jj kk ll mm nn aa bb cc dd ee ff gg hh ii jj kk ll mm nn")]
DOCS = [
    (1, "… WHAT is,the tallest--mountain of the whole wide world; seen from its base?? mauna kea and more"), (2, "short answer 42"), (3, "short answer 422"), (4, "xshort answer 42"), (5, None), (6, ""), (None, "a short ANSWER: 42"), (7, "word " * 100_000 + "Short answer:\n42 end"),
    (8, "what is the tallest mountain of the whole wide world seen from its"), (9, "what is the tallest mountain of the whole wide world seen"), (10, "short answer 42 short answer 42 then short answer 42"), (2, "short answer 42"), (11, "aa bb cc dd ee ff gg hh ii jj kk ll mm nn " * 3), (12, "Ä short answer 42 ǅ"), (13, "null item words here"),
]


def test_cases(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in DOCS], "doc_id long, text string, start int, item_id string")
    items = spark.createDataFrame([(*r, 5) for r in ITEMS], "item_id long, text string, doc_id int")
    want = brute.contamination(DOCS, ITEMS)
    found = got(op.contamination(df, items))
    assert found == want
    assert {r[0] for r in found} == {1, 2, None, 7, 8, 10, 11, 12, 13}
    (whole,) = [r for r in found if r[0] == 1]
    assert DOCS[0][1][whole[2] : whole[3]].startswith("WHAT is") and DOCS[0][1][whole[2] : whole[3]].endswith("kea")
    kept = op.drop_contaminated(df, items)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "4", "5", "6", "9"])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(op.contamination(docs.limit(0), items)) == set()
    assert got(op.contamination(docs, items.limit(0))) == set()


def test_exact_copies_in_every_script_are_found(spark):
    """Letters whose lower case differs between engines, and characters of which engines differ on whether they are letters."""
    words = ["İstanbul hangi ülkede bulunur ve nüfusu kaçtır", "ΟΔΟΣ ΤΩΝ ΑΓΓΕΛΩΝ ΕΙΝΑΙ ΕΔΩ ΣΗΜΕΡΑ", "Straße ẞ und ǅ DŽ ﬁ ﬀ", "a\u0558b \u0378 c\U0001e900d e\u1c89f g\u0ec0\u0e33", "日本語の文章 テスト", "e\u0301te\u0301 caf\u00e9 ₂ Ⅷ ⅷ ①"]
    items = spark.createDataFrame(list(enumerate(words)), "item_id long, text string")
    docs = [(k, f"{left}{w}{right}") for k, (w, left, right) in enumerate((w, left, right) for w in words for left, right in (("", ""), ("before \u0558 İİ ", " after ΣΑΣ"), ("x\u0378 \U0001f600 ", ".")))]
    hits = got(op.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items))
    assert {(d, i) for d, i, *_ in hits} >= {(k, k // 3) for k in range(len(docs))}
    for d, i, start, end, _ in hits:
        if d // 3 == i:
            found, text = docs[d][1][start:end], words[i]
            assert found in text and len(found) >= len(text) - 2 and op.normal_of(pa.array([found])) == op.normal_of(pa.array([text]))
    upper = got(op.contamination(spark.createDataFrame([(1, "οδός των αγγέλων")], "doc_id long, text string"), spark.createDataFrame([(1, "ΟΔΌΣ ΤΩΝ ΑΓΓΈΛΩΝ")], "item_id long, text string")))
    assert {h[:2] for h in upper} == {(1, 1)}


def test_rows_are_dropped_by_their_own_text(spark):
    items = spark.createDataFrame([(2, "Short answer: 42!"), (None, "the other item")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a short answer 42"), (None, "clean"), (5, "clean"), (5, "short answer 42"), (6, "the other item."), (7, None)], "doc_id long, text string")
    kept = sorted((tuple(r) for r in op.drop_contaminated(docs, items).collect()), key=repr)
    assert kept == sorted([(None, "clean"), (5, "clean"), (7, None)], key=repr)
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r["doc_id"] for r in op.contamination(named, items).collect()} == {None}
