"""Settings of the engine; their values are part of the queries' meaning."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from urllib.parse import unquote, urlsplit

RANK_OFFSET, OVER_FETCH, LEAST_FETCH, WINDOW_SLACK = 60, 3, 20, 5
TITLE_FIFTHS, BODY_FIFTHS = 5, 1  # weights 1.0 and 0.2, in fifths
BYTES_PER_TOKEN = 4
EMBEDDING_BYTES = 8000
LEAST_TOKEN, MOST_VARIANTS, LEAST_SIMILARITY, TRIGRAM_GATE = 4, 1, 0.5, 0.3
IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_\-]{0,62}")

#: Model: dollars per million tokens in and out.
PRICES = {"text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0), "gpt-mini": (0.20, 1.25), "gpt-medium": (0.75, 4.50), "gpt-large": (2.50, 15.00)}
#: Languages with a text search configuration of their own; others are 'simple'.
LANGUAGES = ("arabic", "armenian", "basque", "catalan", "danish", "dutch", "english", "estonian", "finnish", "french", "german", "greek", "hindi", "hungarian", "indonesian", "irish", "italian", "lithuanian", "nepali", "norwegian", "portuguese", "romanian", "russian", "serbian", "spanish", "swedish", "tamil", "turkish", "yiddish")
LOCALES = {"ar": "arabic", "hy": "armenian", "eu": "basque", "ca": "catalan", "da": "danish", "nl": "dutch", "en": "english", "et": "estonian", "fi": "finnish", "fr": "french", "de": "german", "el": "greek", "hi": "hindi", "hu": "hungarian", "id": "indonesian", "ga": "irish", "it": "italian", "lt": "lithuanian", "ne": "nepali", "no": "norwegian", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sr": "serbian", "es": "spanish", "sv": "swedish", "ta": "tamil", "tr": "turkish", "yi": "yiddish"}


@dataclass(frozen=True)
class Settings:
    semantic_weight: float = 0.3
    keyword_weight: float = 0.7
    prompt_tokens: int = 12000
    least_chunk: int = 100
    target_chunk: int = 400
    most_chunk: int = 600
    overlap: int = 40
    chunk_threshold: int = 500
    cache_days: int = 7
    least_semantic: float = 0.15
    most_semantic: int = 100
    excerpt: int = 200
    typo_tolerance: bool = True
    searches_per_minute: int = 10
    searches_per_hour: int = 30
    answers_per_minute: int = 30
    answers_per_hour: int = 30
    answers_at_once: int = 2
    all_answers_at_once: int = 10
    daily_budget: float = 3.0

    def problems(self) -> list[str]:
        """What is wrong with these settings, in order of the checks; empty if nothing."""
        limits = {"least_chunk": (10, 500), "target_chunk": (100, 1000), "most_chunk": (200, 2000), "overlap": (0, 200), "chunk_threshold": (100, 1000), "cache_days": (0, 30), "least_semantic": (0, 1), "most_semantic": (10, 500), "excerpt": (50, 500), "prompt_tokens": (500, 100_000), "semantic_weight": (0, 1), "keyword_weight": (0, 1), "daily_budget": (0, float("inf"))}
        limits |= {k: (0, 100_000) for k in ("searches_per_minute", "searches_per_hour", "answers_per_minute", "answers_per_hour")} | {k: (1, 100_000) for k in ("answers_at_once", "all_answers_at_once")}
        out = [f"{f.name} must be from {a} to {b}" for f in fields(self) if f.name in limits and not (a := limits[f.name][0]) <= getattr(self, f.name) <= (b := limits[f.name][1])]
        if abs(self.semantic_weight + self.keyword_weight - 1) > 0.001:
            out.append("semantic_weight and keyword_weight must sum to 1")
        if not self.least_chunk < self.target_chunk < self.most_chunk:
            out.append("least_chunk, target_chunk, most_chunk must increase")
        if self.overlap >= self.least_chunk:
            out.append("overlap must be below least_chunk")
        return out


def clamp_limit(n: int) -> int:
    """The number of results: 10 if below 1, 100 at most."""
    return 10 if n < 1 else min(n, 100)


def valid_table(name: str) -> bool:
    return IDENTIFIER.fullmatch(name) is not None


def language_of(locale: str | None) -> str:
    """The text search configuration for a locale such as de-CH."""
    return LOCALES.get(re.split("[-_]", (locale or "").lower())[0], "simple")


#: Error code: HTTP status, message.
ERRORS = {
    "invalid_query": (400, "The query is empty or too long."), "invalid_type": (400, "Unknown search type."), "invalid_site": (400, "Unknown site."), "forbidden": (403, "Access denied."), "no_entry": (404, "There is no such entry."), "no_url": (422, "The entry has no URL and can't be indexed."),
    "rate_limited": (429, "Too many requests."), "busy": (429, "Too many answers at once."), "embedding_limited": (429, "The embedding service is busy."), "search_failed": (500, "The search failed."), "answer_failed": (502, "The answer could not be made."),
    "no_key": (503, "No key is set for the provider."), "unavailable": (503, "The index is unavailable."), "unknown": (500, "Something went wrong."),
}
QUERY_CHARS = 150


def section_handles(raw: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """A list, or handles with commas between: trimmed, empty ones left out. Anything else is no filter."""
    if isinstance(raw, str):
        return [x for x in (h.strip() for h in raw.split(",")) if x and x != "0"]
    return [str(x) for x in raw] if isinstance(raw, (list, tuple)) else []


def resolve_site(raw: int | str | None, known: list[int]) -> int | None:
    """The site to search, None for all. With one site the parameter may be left out; with several it is needed, and 0 means all. ValueError for others."""
    try:
        n = int(raw or 0)
    except (TypeError, ValueError):
        n = 0
    if len(known) <= 1:
        only = known[0] if known else None
        if n in (0, only):
            return only
    elif raw not in (None, "") and (n == 0 or n in known):
        return n or None
    raise ValueError("invalid_site")


def origin_of(url: str) -> str | None:
    """scheme://host[:port] in lower case, without a default port; None if there is no host."""
    parts = urlsplit(url.strip())
    try:
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    return f"{parts.scheme}://{parts.hostname}" + (f":{port}" if port and port != {"http": 80, "https": 443}[parts.scheme] else "")


def connection_of(uri: str) -> dict[str, str | int | None]:
    """host, port, database, user, password of a connection URI, percent-decoded; ValueError without host or database."""
    parts = urlsplit(uri)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname or len(parts.path) < 2:
        raise ValueError("a connection needs a scheme, a host and a database")
    plain = lambda x: None if x is None else unquote(x)
    return {"host": parts.hostname, "port": parts.port or 5432, "database": unquote(parts.path[1:]), "user": plain(parts.username), "password": plain(parts.password)}


def known_settings(values: dict, allowed: tuple[str, ...]) -> dict:
    """The values of the settings that a form may set; others are left out."""
    return {k: v for k, v in values.items() if k in allowed and k in {f.name for f in fields(Settings)}}


@dataclass(frozen=True)
class Request:
    """Parameters of a search, as they come."""

    query: str
    limit: int = 10
    site_id: int | None = None
    sections: tuple[str, ...] = ()

    @classmethod
    def of(cls, query: str | None, limit: int | str | None = None, site_id: int | str | None = None, sections: str | list[str] | None = None, sites: list[int] | None = None) -> "Request":
        """Checks and normalises; ValueError with an error code."""
        from .functions.text import sanitize_text

        query = sanitize_text(query or "")
        if not query or len(query) > QUERY_CHARS:
            raise ValueError("invalid_query")
        try:
            n = int(limit or 0)
        except (TypeError, ValueError):
            n = 0
        return cls(query, clamp_limit(n), resolve_site(site_id, sites or []), tuple(section_handles(sections)))
