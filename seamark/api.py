"""The callable surface: search, answers, the search action with its JSON envelope, insights, index actions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ERRORS, Request, Settings
from .functions.scalar import allowed_range, trending_window
from .hooks import Hooks
from .operators import boosts, dashboard, history, index, lexical, rag, semantic
from .plans import hybrid
from .store import SearchIndex, matching


class SearchError(Exception):
    """An error with a code of config.ERRORS."""

    def __init__(self, code: str, retry_after: int | None = None):
        super().__init__(code)
        self.code, self.retry_after = code, retry_after


def error_body(code: str, request_id: str | None = None, retry_after: int | None = None) -> tuple[int, dict]:
    """(HTTP status, body) of an error; what went wrong inside never shows."""
    status, message = ERRORS.get(code, ERRORS["unknown"])
    body: dict = {"success": False, "code": code if code in ERRORS else "unknown", "message": message if request_id is None else f"{message} (Reference: {request_id})"}
    if request_id is not None:
        body["requestId"] = request_id
    if retry_after is not None:
        body["retryAfter"] = retry_after
    return status, body


@dataclass
class Engine:
    """Search over a stored index. Tables: entries, vectors(element_id, site_id, section_id, chunk, vector), boosts, sections(section_id, handle), sites."""

    spark: SparkSession
    index: SearchIndex
    entries: DataFrame
    vectors: DataFrame
    boosts: DataFrame
    sections: DataFrame
    sites: DataFrame
    settings: Settings = field(default_factory=Settings)
    hooks: Hooks = field(default_factory=Hooks)

    def section_ids(self, handles: list[str]) -> list[int] | None:
        """None without handles; the ids of the known ones otherwise (a list of the sections that the site defines, not of data)."""
        if not handles:
            return None
        return [r[0] for r in self.sections.filter(F.col("handle").isin(list(handles))).select("section_id").collect()]

    def variants(self, query: str) -> DataFrame:
        """(raw, lexeme, term, sim, df) of the query's tokens, both clean ones and raw words."""
        words = list(dict.fromkeys([*lexical.clean_tokens(query), *query.lower().split()]))
        grams = sorted({("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)})
        return lexical.close_terms(words, matching_terms(self.index.terms, words), matching(self.index.grams, "gram", grams))

    def ranked(self, query: str, site_id: int | None = None, sections: list[int] | None = None, vector: DataFrame | None = None, limit: int = 10) -> DataFrame:
        """The fused and boosted elements of a query, unordered."""
        s = self.settings
        found = self.variants(query).select("raw", "term")
        best = {r["raw"]: r["term"] for r in found.collect()}  # a row for each token of the query, at most
        wanted, corrected = lexical.search_lexemes(query), lexical.corrected_lexemes(query, best, s.typo_tolerance)
        postings = matching(self.index.postings, "lexeme", list(dict.fromkeys([*wanted, *corrected])))
        keyword = lexical.best_chunks(lexical.posting_scores(postings, wanted, corrected, site_id, sections), s.most_semantic)
        if vector is None:
            vector = self.spark.createDataFrame([(self.hooks.embed(query),)], "q array<float>")
        near = semantic.semantic(self.vectors, vector, min(s.most_semantic, 10 * limit), site_id, sections)
        # Boosts look at neither sections nor the typo setting.
        text = self.spark.createDataFrame([(query,)], "query string")
        slots = boosts.expanded(text, self.spark.createDataFrame(list(best.items()), "raw string, term string"))
        return hybrid.add_boosts(hybrid.fuse(near, keyword, s), boosts.match(self.boosts, slots, site_id))

    def search(self, query: str, limit: int = 10, site_id: int | None = None, sections: list[str] | None = None, vector: DataFrame | None = None) -> DataFrame:
        """The results of a query, best first: element_id, title, url, scores, ranks, smart_rank, content. Section handles of which none is known give none."""
        ids = self.section_ids(sections or [])
        if not query.strip() or ids == []:
            ids, query = [-1], ""  # the same columns, no rows
            return hybrid.hydrate(hybrid.fuse(semantic.semantic(self.vectors.limit(0), self.spark.createDataFrame([([0.0],)], "q array<float>"), 1), lexical.best_chunks(lexical.posting_scores(self.index.postings.limit(0), []), 1), self.settings), self.entries, self.index.chunks, limit)
        return hybrid.hydrate(self.ranked(query, site_id, ids, vector, limit), self.entries, self.index.chunks, limit)

    def formatted(self, results: DataFrame) -> DataFrame:
        return hybrid.formatted(results, self.settings.excerpt)

    def payload(self, results: DataFrame, kind: str = "search") -> list[dict]:
        """A page of results (at most 100) as JSON objects: absent ranks left out, listeners' fields added."""
        handles = F.broadcast(self.sections.select("section_id", F.col("handle").alias("section_handle")))
        own = F.broadcast(results.select("element_id", F.col("url").alias("u")))
        section = self.entries.join(own, "element_id", "left_semi").select("element_id", "section_id").dropDuplicates(["element_id"]).join(handles, "section_id", "left").select("element_id", "section_handle")
        out = []
        for r in self.formatted(results).join(section, "element_id", "left").orderBy("smart_rank").collect():
            row = {"id": r["element_id"], "title": r["title"], "url": r["url"], "type": kind, "sectionHandle": r["section_handle"], "score": r["score"], "excerpt": r["excerpt"], "semanticScore": r["semantic_score"], "keywordScore": r["keyword_score"]}
            row |= {n: r[c] for n, c in (("semanticRank", "semantic_rank"), ("keywordRank", "keyword_rank"), ("smartRank", "smart_rank")) if r[c] is not None}
            if fields := self.hooks.fields_of(row):
                row["fields"] = fields
            out.append(row)
        return out

    def context(self, results: DataFrame) -> DataFrame:
        return rag.context(rag.pack(results.withColumnRenamed("smart_rank", "rank"), rag.default_budget(self.settings)))

    def ai_answer(self, query: str, limit: int = 5, site_id: int | None = None, vector: DataFrame | None = None, budget_spent: bool = False) -> dict:
        """{summary, sources, confidence, aiAnswer}: the provider answers from the packed results; with the budget spent, the results alone in the same shape."""
        results = self.search(query, limit, site_id, vector=vector).select("element_id", "title", "url", "content", "smart_rank").orderBy("smart_rank").limit(limit).collect()
        kind = "element_id long, title string, url string, content string, smart_rank int"
        kept = self.spark.createDataFrame([tuple(r) for r in results], kind)
        if budget_spent:
            return {"summary": None, "sources": [{"id": r["element_id"], "title": r["title"], "url": r["url"], "rank": r["smart_rank"]} for r in results], "confidence": None, "aiAnswer": True, "budgetExhausted": True}
        if not results:
            return {"summary": None, "sources": [], "confidence": None, "aiAnswer": False}
        messages = [r.asDict() for r in rag.messages(self.spark.createDataFrame([(query,)], "query string"), self.context(kept)).collect()]
        reply = self.spark.createDataFrame([(1, self.hooks.answer(messages))], "reply_id long, reply string")
        (parsed,) = (told := rag.parse(reply)).collect()
        if not parsed["ok"]:
            raise SearchError("answer_failed")
        sources = rag.sources(told, kept, limit).orderBy("rank").collect()
        return {"summary": parsed["summary"], "sources": [{"id": r["element_id"], "title": r["title"], "url": r["url"], "rank": r["rank"]} for r in sources], "confidence": parsed["confidence"], "aiAnswer": True}

    def answer_events(self, query: str, limit: int = 5, site_id: int | None = None) -> Iterator[tuple[str, str]]:
        """The answer as server-sent events: sources once, its words one by one, done; or error."""
        try:
            answer = self.ai_answer(query, limit, site_id)
        except Exception as e:
            yield "error", json.dumps(error_body(e.code if isinstance(e, SearchError) else "unknown")[1])
            return
        yield "sources", json.dumps(answer["sources"])
        for token in (answer["summary"] or "").split(" "):
            yield "token", json.dumps(token)
        yield "done", json.dumps({"confidence": answer["confidence"]})

    def action(self, parameters: dict, kind: str = "search", budget_spent: bool = False) -> tuple[int, dict]:
        """(HTTP status, body) of a search request: q, limit, siteId, sections; kind is search or ai-answer. The body goes out as JSON."""
        request_id = uuid.uuid4().hex
        try:
            if kind not in ("search", "ai-answer"):
                raise SearchError("invalid_type")
            known = [r[0] for r in self.sites.select("site_id").collect()]
            try:
                r = Request.of(parameters.get("q"), parameters.get("limit"), parameters.get("siteId"), parameters.get("sections"), known)
            except ValueError as e:
                raise SearchError(str(e)) from None
            if kind == "search":
                return 200, {"success": True, "results": self.payload(self.search(r.query, r.limit, r.site_id, list(r.sections)))}
            return 200, {"success": True} | self.ai_answer(r.query, r.limit, r.site_id, budget_spent=budget_spent)
        except SearchError as e:
            return error_body(e.code, None if e.code in ("invalid_query", "invalid_site", "invalid_type") else request_id, e.retry_after)
        except Exception:
            return error_body("search_failed" if kind == "search" else "answer_failed", request_id)


def matching_terms(terms: DataFrame, words: list[str]) -> DataFrame:
    """The dictionary's rows of these words; the filter reaches the scan."""
    return terms.filter(F.col("term").isin(words)) if words else terms.limit(0)


def insights(log: DataFrame, now: str, view: str, days: int = 30, page: int = 1, size: int = 25) -> DataFrame:
    """The insights views: overview, top-queries, zero-results, trending."""
    days = allowed_range(days)
    if view == "overview":
        return history.stats(history.within(log, now, days))
    if view == "top-queries":
        return history.shares(history.within(log, now, days, named=True), size)
    if view == "zero-results":
        return history.top_queries(history.within(log, now, days, named=True, zero=True), size, (page - 1) * size)
    if view == "trending":
        return history.trending(log, now, 7, 100)
    raise ValueError(f"no view {view}")


def dashboard_views(log: DataFrame, entries: DataFrame, vectors: DataFrame, excluded: DataFrame, now: str, days: int = 30, cap: float = Settings.daily_budget, has_key: bool = True) -> dict[str, DataFrame]:
    """All frames of the dashboard by name; each is lazy."""
    days = allowed_range(days)
    series = history.daily(log, now, days)
    seen = dashboard.traffic(series)
    numbers = dashboard.figures(log, history.days_before(now, days), now[:10])
    cover = index.coverage_totals(index.coverage(index.statuses(entries, vectors, excluded)))
    budgeted = dashboard.budget(numbers.select("spent"), seen.select("burn", "days_with_data"), cap)
    return {
        "series": series, "kpi": dashboard.half_windows(series, days), "top": history.top_queries(history.within(log, now, days, named=True), 10), "trending": history.trending(log, now, trending_window(days), 10),
        "errors": history.recent_errors(log, 10), "coverage": cover, "budget": budgeted, "health": dashboard.health(index.stats(vectors), budgeted, now, has_key),
        "advice": dashboard.advice(numbers, seen, cover, cap, has_key),
    }
