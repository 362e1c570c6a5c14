"""The callable surface, hooks, extraction, the stored index."""

import json

import pytest

from seamark import api, config, store
from seamark.config import Settings
from seamark.functions import text
from seamark.hooks import Hooks, hash_embedding
from seamark.operators import extract, index
from seamark.plans import catalog, hybrid

NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def engine(spark, small):
    return catalog.engine(spark, small)


def test_envelope_of_a_search(engine):
    status, body = engine.action({"q": catalog.TYPED, "limit": "3", "siteId": "0", "sections": " section-1, section-2 ,,x"})
    assert status == 200 and body["success"] and 0 < len(body["results"]) <= 3
    first = body["results"][0]
    assert {"id", "title", "url", "type", "sectionHandle", "score", "excerpt", "semanticScore", "keywordScore", "smartRank"} <= set(first) and "fields" not in first
    assert [r["smartRank"] for r in body["results"]] == list(range(1, len(body["results"]) + 1)) and json.loads(json.dumps(body)) == body
    assert all(v is not None for r in body["results"] for k, v in r.items() if k.endswith("Rank"))


def test_envelope_of_errors(engine, monkeypatch):
    for parameters, kind, want in (({"q": " ", "siteId": 1}, "search", (400, "invalid_query")), ({"q": "x" * 151, "siteId": 1}, "search", (400, "invalid_query")), ({"q": "x"}, "search", (400, "invalid_site")), ({"q": "x", "siteId": 77}, "search", (400, "invalid_site")), ({"q": "x", "siteId": 1}, "odd", (400, "invalid_type"))):
        status, body = engine.action(parameters, kind)
        assert (status, body["code"]) == want and body["success"] is False and "requestId" not in body
    monkeypatch.setattr(api.Engine, "search", lambda *a, **k: 1 / 0)
    status, body = engine.action({"q": "x", "siteId": 1})
    assert status == 500 and body["code"] == "search_failed" and body["requestId"] in body["message"] and "division" not in json.dumps(body)
    assert api.error_body("rate_limited", "r", 7)[1]["retryAfter"] == 7 and api.error_body("odd")[1]["code"] == "unknown"


def test_result_listeners_add_fields_and_may_fail(engine):
    engine.hooks.result_fields += [lambda r: {"twice": r["id"] * 2}, lambda r: 1 / 0]
    try:
        rows = engine.action({"q": catalog.TYPED, "siteId": 0, "limit": 2})[1]["results"]
        assert rows and all(r["fields"] == {"twice": str(r["id"] * 2)} for r in rows)
    finally:
        engine.hooks.result_fields.clear()


def test_answers(engine):
    answer = engine.ai_answer(catalog.TYPED, 3)
    assert answer["aiAnswer"] and answer["confidence"] == "high" and [s["rank"] for s in answer["sources"]] == [1, 2, 3]
    spent = engine.ai_answer(catalog.TYPED, 3, budget_spent=True)
    assert spent["summary"] is None and spent["budgetExhausted"] and [s["id"] for s in spent["sources"]] == [s["id"] for s in answer["sources"]]
    events = list(engine.answer_events(catalog.TYPED, 2))
    assert [e for e, _ in events][0] == "sources" and [e for e, _ in events][-1] == "done" and {e for e, _ in events[1:-1]} == {"token"}
    told = engine.hooks.answer
    engine.hooks.answer = lambda messages: "not json"
    try:
        status, body = engine.action({"q": catalog.TYPED, "siteId": 0, "limit": 2}, "ai-answer")
        assert status == 502 and body["code"] == "answer_failed" and list(engine.answer_events(catalog.TYPED, 2))[-1][0] == "error"
    finally:
        engine.hooks.answer = told


def test_empty_searches(engine):
    for found in (engine.search("  ", 5), engine.search("x", 5, sections=["nowhere"])):
        assert found.count() == 0 and {"element_id", "smart_rank", "content"} <= set(found.columns)


def test_typo_tolerance_is_a_setting(spark, small, engine):
    off = api.Engine(spark, engine.index, engine.entries, engine.vectors, engine.boosts, engine.sections, engine.sites, Settings(typo_tolerance=False))
    words = lambda e: {r["element_id"] for r in e.ranked("thtiom", vector=spark.createDataFrame([([0.0] * 64,)], "q array<float>")).filter("keyword_rank > 0").collect()}
    assert words(engine) and not words(off)


def test_stored_index_agrees_with_a_scan(spark):
    rows = [(1, 1, 0, 0, "Red house", "a red red car"), (1, 1, 0, 1, "Red house", "nothing"), (2, 2, 1, 0, None, None), (3, 1, 1, 0, "x", "The house " * 50)]
    chunks = spark.createDataFrame(rows, "element_id long, site_id int, section_id int, chunk int, title string, body string")
    ix = store.build(chunks)
    assert {r["lexeme"]: r["fifths"] for r in store.matching(ix.postings, "lexeme", ["red", "house", "none"]).filter("element_id = 1 AND chunk = 0").collect()} == {"red": 7, "house": 5}
    assert {r["term"]: r["df"] for r in ix.terms.collect()} == {"red": 4, "house": 52, "car": 1, "nothing": 1, "the": 50}
    assert store.matching(ix.postings, "lexeme", []).count() == 0
    plan = store.matching(ix.postings, "lexeme", ["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [In(lexeme" in plan or "EqualTo(lexeme" in plan


FIELDS = [
    ("plain", "text", True, '"<b>bold</b> text"'), ("raw", "text", None, "not json"), ("n", "table", True, '[1, "two", ["<i>three</i>", ""], {"a": 4.5, "b": true}, null]'), ("d", "date", True, '"2024-03-05T07:08:09"'), ("t", "time", True, '"2024-03-05T07:08:09"'),
    ("bad", "date", True, '"never"'), ("l", "link", True, '"x"'), ("a", "asset", True, '["x"]'), ("off", "text", False, '"x"'), ("null", "text", True, None), ("r", "relation", True, '[{"title": "One"}, {"title": " "}, {"title": "Two"}, 5]'),
    ("e", "entries", True, '[{"fields": [{"kind": "text", "value": "inner"}, {"kind": "link", "value": "x"}, {"kind": "text", "value": "hidden", "searchable": false}]}, {"fields": [{"kind": "date", "value": "2024-01-02"}]}]'),
    ("b", "blocks", True, '[{"type": "quote", "fields": {"x": "said", "y": ["more"]}}, {"type": "image", "fields": {}}]'),
]


def test_fields_of_every_kind(spark):
    df = spark.createDataFrame([(1, FIELDS), (2, None)], f"element_id long, fields {extract.FIELDS}").select("element_id", extract.report()("fields").alias("r"))
    by = {r["element_id"]: r["r"] for r in df.collect()}
    assert by[2] == []
    got = {f["handle"]: (f["reason"], f["text"]) for f in by[1]}
    assert got == {
        "plain": ("", "bold text"), "raw": ("", "not json"), "n": ("", "1 two three 4.5"), "d": ("", "March 5, 2024"), "t": ("", "07:08"), "bad": ("no extractable text", ""), "l": ("skipped", ""), "a": ("skipped", ""),
        "off": ("searchable=false", ""), "null": ("null value", ""), "r": ("", "One, Two"), "e": ("", "inner January 2, 2024"), "b": ("", "said more"),
    }
    (blocks,) = [f["blocks"] for f in by[1] if f["handle"] == "b"]
    assert [(b["label"], b["text"]) for b in blocks] == [("quote #1", "said more"), ("image #2", "")]


def test_field_and_boost_listeners(spark):
    hooks = Hooks(field_text=[lambda handle, kind, t: t.upper() if handle == "plain" else t, lambda *a: 1 / 0, lambda *a: None], boosts=[lambda e, s, t: [{"terms": [t, " "], "weight": 0.5}, {"terms": ["none"], "weight": 0}], lambda *a: 1 / 0, lambda *a: [{"odd": 1}]])
    rows = {f["handle"]: f["text"] for f in extract.inspect_fields([dict(zip(("handle", "kind", "searchable", "value"), f)) for f in FIELDS], hooks)}
    assert rows["plain"] == "BOLD TEXT" and rows["r"] == "One, Two"
    e = spark.createDataFrame([(1, 1, "T", "/t", "enabled"), (2, 1, "U", None, "enabled")], "element_id long, site_id int, title string, url string, status string")
    stored = spark.createDataFrame([(1, 1, ["old"], 1.0, "old"), (2, 1, ["kept"], 1.0, "kept")], "element_id long, site_id int, terms array<string>, weight double, label string")
    assert sorted((r["element_id"], r["label"], r["weight"]) for r in extract.sync_boosts(stored, e, hooks).collect()) == [(1, "T", 0.5), (2, "kept", 1.0)]


def test_indexing_embeds_only_what_changed(spark):
    kind = "element_id long, site_id int, section_id int, title string, url string, status string, updated timestamp, fields " + extract.FIELDS
    make = lambda rows: spark.createDataFrame([(i, 1, 0, t, "/u", s, None, [("b", "text", True, json.dumps(x))]) for i, t, s, x in rows], kind)
    stored = "element_id long, site_id int, section_id int, title string, content_hash string, total int, chunk int, body string, indexed timestamp, vector array<float>"
    none = spark.createDataFrame([], "element_id long, site_id int")
    long = "\n\n".join(f"Paragraph {k}. " + "word " * 150 for k in range(8))
    first = extract.index_entries(spark.createDataFrame([], stored), make([(1, "A", "enabled", "short"), (2, "B", "enabled", long), (3, "C", "disabled", "x")]), none, NOW, Settings())
    rows = first.collect()
    assert {r["element_id"] for r in rows} == {1, 2} and [r["body"] for r in rows if r["element_id"] == 1] == ["A\n\nshort"]
    assert [r["body"] for r in sorted(rows, key=lambda r: r["chunk"]) if r["element_id"] == 2] == text.chunk_text("B\n\n" + long, Settings())
    assert all(r["vector"] == pytest.approx(hash_embedding(r["body"]), abs=1e-6) for r in rows)
    marked = spark.createDataFrame([(*r[:-1], [9.0]) if len(r) == 10 else r for r in map(tuple, first.select(*[c.split()[0] for c in stored.split(", ")]).collect())], stored)
    again = extract.index_entries(marked, make([(1, "A", "enabled", "short"), (2, "B", "enabled", "now short")]), none, NOW, Settings())
    assert {(r["element_id"], r["vector"] == [9.0]) for r in again.collect()} == {(1, True), (2, False)}
    calls = Hooks(embed=lambda t: [1.0, 0.0])
    assert spark.createDataFrame([("a",), (" ",), (None,), ("a",)], "t string").select(calls.embedding()("t").alias("v")).collect() == [([1.0, 0.0],), (None,), (None,), ([1.0, 0.0],)]


def test_sync_decisions(spark):
    kind = "element_id long, site_id int, section_id int, title string, url string, status string, text string, chunks array<string>"
    e = spark.createDataFrame([(1, 1, 7, "t", "/u", "enabled", "same", ["same"]), (2, 1, 7, "t", "/u", "enabled", "new", ["n", "ew"]), (3, 1, 7, "t", "/u", "disabled", "x", ["x"]), (4, 1, 7, "t", "/u", "enabled", " ", [" "]), (5, 1, 7, "t", None, "enabled", "x", ["x"]), (6, 1, 7, "t", "/u", "enabled", "x", ["x"])], kind)
    import hashlib

    h = hashlib.sha256(b"same").hexdigest()
    stored = spark.createDataFrame([(i, 1, 0, h) for i in (1, 2, 3, 4, 5, 6, 9)], "element_id long, site_id int, chunk int, content_hash string")
    gone = spark.createDataFrame([(6, 1), (6, 1)], "element_id long, site_id int")
    got = {r["element_id"]: r["action"] for r in index.decisions(stored, e, gone).collect()}
    assert got == {1: "touch", 2: "embed", 3: "delete", 4: "keep", 5: "delete", 6: "delete", 9: "delete"}


def test_parameters():
    assert config.section_handles(" a, b ,,") == ["a", "b"] and config.section_handles(["x "]) == ["x "] and config.section_handles(5) == [] and config.section_handles(None) == []
    assert config.resolve_site(None, [3]) == 3 and config.resolve_site("0", [3]) == 3 and config.resolve_site(None, []) is None
    assert config.resolve_site("0", [1, 2]) is None and config.resolve_site(2, [1, 2]) == 2
    for raw, known in ((None, [1, 2]), ("", [1, 2]), (9, [1, 2]), (9, [3]), ("x", [3, 4]) if False else (8, [3, 4])):
        with pytest.raises(ValueError):
            config.resolve_site(raw, known)
    r = config.Request.of("  a<|x|>b\x07  ", "500", "1", "h", [1, 2])
    assert (r.query, r.limit, r.site_id, r.sections) == ("ab", 100, 1, ("h",)) and config.Request.of("q", -1, 1, None, [1]).limit == 10 and config.Request.of("q", "many", 1, None, [1]).limit == 10
    assert config.origin_of("HTTPS://Ex.org:443/a?b") == "https://ex.org" and config.origin_of("http://ex.org:8080") == "http://ex.org:8080" and config.origin_of("/x") is None and config.origin_of("http://x:99999") is None
    assert config.connection_of("postgres://u:p%40@db.example:6543/my%20db") == {"host": "db.example", "port": 6543, "database": "my db", "user": "u", "password": "p@"}
    with pytest.raises(ValueError):
        config.connection_of("mysql://x/y")
    assert config.known_settings({"excerpt": 90, "overlap": 5, "odd": 1}, ("excerpt", "odd")) == {"excerpt": 90}
    assert config.language_of("de-CH") == "german" and config.language_of("xx") == "simple"


def test_insights_and_dashboard(spark, small):
    log = catalog.tables.history(spark, small)
    for view in ("overview", "top-queries", "zero-results", "trending"):
        assert api.insights(log, NOW, view).columns
    with pytest.raises(ValueError):
        api.insights(log, NOW, "odd")
    views = api.dashboard_views(log, catalog.tables.entries(spark, small), catalog.tables.vectors(spark, small), catalog.tables.excluded(spark, small), "2024-01-30 12:00:00", 31, has_key=False)
    assert views["series"].count() == 31 and {r["about"] for r in views["advice"].collect()} >= {"no-key"} and views["budget"].first()["spent"] > 0
    assert {r["key"]: r["state"] for r in views["health"].collect()}["api"] == "crit"


def test_scores_of_one_side_are_zero(spark):
    near = spark.createDataFrame([(1, 1, 0, 0.9, 1)], "element_id long, site_id int, chunk int, similarity double, rank int")
    key = spark.createDataFrame([(2, 1, 0, 0.4, 1)], "element_id long, site_id int, chunk int, score double, rank int")
    got = {r["element_id"]: r for r in hybrid.fuse(near, key, Settings()).collect()}
    assert (got[1]["keyword_score"], got[1]["keyword_rank"], got[2]["semantic_score"], got[2]["semantic_rank"]) == (0.0, None, 0.0, None)
