import datetime

import pytest
from pyspark.sql import functions as F

from seamark.config import Settings, clamp_limit, valid_table
from seamark.functions import scalar, text
from seamark.operators import boosts, lexical, rag

S = Settings(least_chunk=10, target_chunk=20, most_chunk=40, overlap=3, chunk_threshold=15)


def test_short_text_is_one_chunk():
    assert text.chunk_text("a b c", S) == ["a b c"]


def test_paragraphs_are_packed_with_overlap():
    parts = [f"paragraph number {k} has some words in it." for k in range(6)]  # 10 tokens each
    out = text.chunk_text("\n\n".join(parts), S)
    assert len(out) > 1 and out[0] == "\n\n".join(parts[:2])
    for a, b in zip(out, out[1:]):
        assert b.startswith(a.encode()[-12:].decode().partition(" ")[2])
    assert all(any(p in c for c in out) for p in parts)


def test_long_paragraph_by_sentences_and_bytes():
    sentence = "This is one of many sentences. "
    out = text.chunk_text(sentence * 20, S)
    assert "".join(out).replace(" ", "") == (sentence * 20).replace(" ", "")
    assert all(len(c.encode()) <= 4 * S.most_chunk for c in text.chunk_text("ä" * 1000, S))
    assert "".join(text.chunk_text("ä" * 1000, S)) == "ä" * 1000


def test_zero_survives_as_a_piece():
    assert text.cut_bytes("0", 3) == ["0"] and text.cut_bytes("   ", 2) == []


def test_overlap():
    assert text.overlap_of("short", 3) == "" and text.overlap_of("x" * 50, 0) == ""
    assert text.overlap_of("some words at the end here", 3) == "end here"


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [("link", "x", ""), ("date", datetime.date(2024, 3, 5), "March 5, 2024"), ("time", datetime.time(7, 5), "07:05"), ("relation", [{"title": "A"}, {}, {"title": "B"}], "A, B"), ("asset", "x", ""), ("string", "<b>t</b> x", "t x"), ("string", None, ""), ("array", ["<i>a</i>", [1, 2.5, None, True], {"k": "b"}], "a 1 2.5 b"), ("entries", [{"fields": [{"kind": "string", "value": "in"}]}], "in"), ("blocks", [{"fields": {"a": "x", "b": ["y"]}}], "x y")],
)
def test_field_text(kind, value, want):
    assert text.field_text(kind, value) == want


def test_field_reports():
    assert text.field_report("string", "x", searchable=False) == ("", "searchable=false")
    assert text.field_report("category", "x") == ("", "skipped")
    assert text.field_report("string", None) == ("", "null value")
    assert text.field_report("string", "<b></b>") == ("", "no extractable text")
    assert text.field_report("string", "x") == ("x", "")
    assert text.block_report([{"type": "quote", "fields": {"t": "x"}}, {"fields": {}}]) == [("quote #1", "x"), ("block #2", "")]


def test_settings():
    assert Settings().problems() == []
    assert Settings(semantic_weight=0.5).problems() == ["semantic_weight and keyword_weight must sum to 1"]
    assert Settings(overlap=150).problems() == ["overlap must be below least_chunk"]
    assert [clamp_limit(n) for n in (0, 5, 500)] == [10, 5, 100]
    assert valid_table("a_b-1") and not valid_table("1; drop")


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return row.select(*columns).first()


def test_text_columns(spark):
    c = F.col("x")
    assert one(spark, text.sanitize(c), x="  é<|im_start|>\x00a\x07\n```py\n~~~ b\t")[0] == "éa\npy\n b"
    assert one(spark, text.head_bytes(c, 3), x="aää")[0] == "aä" and one(spark, text.head_bytes(c, 2), x="aä")[0] == "a"
    assert one(spark, text.head_bytes(c, 5), x="a😀b")[0] == "a😀" and one(spark, text.head_bytes(c, 4), x="a😀b")[0] == "a"
    assert one(spark, text.strip_tags_exact(c), x='<a title="x>y">t</a>&amp;<!-- c -->')[0] == "t&amp;"
    assert one(spark, text.query_tokens(c), x="A an An, the-other THE")[0] == ["an", "theother", "the"]
    assert one(spark, text.excerpt(c, F.lit("Title"), 10), x="<p>Title and much more text</p>")[0] == "and much …"
    assert one(spark, text.is_empty(c), x=" \t")[0] and one(spark, text.is_empty(c), x=None)[0] and not one(spark, text.is_empty(c), x="0")[0]


def test_scalars(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, scalar.cosine(a, b), a=[1.0, 0.0], b=[1.0, 1.0])[0] == pytest.approx(2**-0.5)
    assert one(spark, scalar.similarity(a, b), a="word", b="words")[0] == pytest.approx(4 / 7)
    assert one(spark, scalar.similarity(a, b), a="same", b="same")[0] == 1
    assert one(spark, scalar.pct_delta(a, b), a=3.0, b=2.0)[0] == 50 and one(spark, scalar.pct_delta(a, b), a=0.0, b=0.0)[0] == 0 and one(spark, scalar.pct_delta(a, b), a=1.0, b=0.0)[0] is None
    rank = lambda s, k, score: one(spark, scalar.rrf(F.lit(s), F.lit(k), F.lit(score), 0.3, 0.7, 60), x="")[0]
    assert rank(1, None, None) == pytest.approx(0.3 / 61) and rank(1, 2, 0.5) == pytest.approx(0.3 / 61 + 0.7 / 62 + 0.7 / 60) and rank(None, 2, 0.49) == pytest.approx(0.7 / 62)


def test_rewrite():
    assert lexical.rewrite("red hous", {"hous": "house", "red": "red"}) == "red | (hous | house)"
    assert lexical.rewrite("Red, HOUS! red a hous", {"hous": "house"}) == "red | (hous | house)"  # clean, distinct, two characters or more
    for q, found, enabled in (("red", {"red": "red"}, True), ("re-d", {"re": "red"}, True), ('"re"', {"re": "red"}, True), ("re", {"re": "red"}, False), ("", {}, True)):
        assert lexical.rewrite(q, found, enabled) is None and lexical.corrected_lexemes(q, found, enabled) == []
    assert lexical.corrected_lexemes("thtiom ertion", {"thtiom": "thtion", "ertion": "ertion"}) == ["thtiom", "ertion", "thtion"]
    assert lexical.search_lexemes("New-York -not or x_1 new") == ["new", "york", "x_1"]


def test_phrases_of_the_examples(spark):
    """`2 bedroom 1 bathroom` lifts rules of phrases in it, in order, and not those that merely share words."""
    rules = spark.createDataFrame([(1, 1, [["2", "bedroom"]], 0.1), (2, 1, [["1", "bathroom"]], 0.2), (3, 1, [["1", "bedroom"]], 0.4), (4, 1, [["2", "bedroom"], ["1", "bathroom"]], 0.8), (4, 1, [["bathroom"]], 0.1), (5, 1, [["2", "bedroom"]], 0.0), (6, 1, [], 1.0), (7, 2, [["2"]], 1.0)], "element_id long, site_id int, phrases array<array<string>>, weight double")
    slots = spark.createDataFrame([([["2"], ["bedroom"], ["1"], ["bathroom", "bath"]],)], "slots array<array<string>>")
    got = {r["element_id"]: round(r["boost"], 6) for r in boosts.match(rules, slots, 1).collect()}
    assert got == {1: 0.1, 2: 0.2, 4: 0.9}


def test_first_block_is_packed_even_over_budget(spark):
    rows = [(k, "t", "u", "x" * (5000 if k == 1 else 40), k) for k in range(1, 5)]
    df = spark.createDataFrame(rows, "element_id long, title string, url string, content string, rank int")
    assert [r["element_id"] for r in rag.pack(df, 600).collect()] == [1]
    assert [r["element_id"] for r in rag.pack(df.filter("rank > 1"), 600).orderBy("rank").collect()] == [2, 3, 4]


def test_history_sink(spark, small, tmp_path):
    from seamark.operators import history
    from seamark.sources import tables

    log = tables.history(spark, small)
    for _ in range(2):
        history.append(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 * log.count() and set(log.columns) <= set(back.columns)
