"""Full-text scores, the term dictionary, and typo correction."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BODY_FIFTHS, LEAST_SIMILARITY, LEAST_TOKEN, LOCALES, MOST_VARIANTS, TITLE_FIFTHS, TRIGRAM_GATE
from ..functions import inverted, scalar, text

_JUNK, _WORD = regex.compile(r"[^\p{L}\p{N}_]+"), regex.compile(r"[\p{L}\p{N}_]+")


def fifths(title: Column, body: Column, wanted: list[str]) -> Column:
    """The weight of the occurrences of wanted lexemes, in fifths: 5 in a title, 1 in a body."""
    terms = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    hits = lambda c: F.size(F.filter(text.lexemes(F.coalesce(c, F.lit(""))), lambda x: F.array_contains(terms, x)))
    return hits(title) * TITLE_FIFTHS + hits(body) * BODY_FIFTHS


def chunk_scores(chunks: DataFrame, wanted: list[str], corrected: list[str] | None = None, site_id: int | None = None, sections: list[int] | None = None) -> DataFrame:
    """chunks that hit, with score: w / (1 + w), and half of the same for the corrected lexemes. Filters reach the scan; no shuffle."""
    if site_id is not None:
        chunks = chunks.filter(F.col("site_id") == site_id)
    if sections is not None:
        chunks = chunks.filter(F.col("section_id").isin(sections))
    saturate = lambda w: w / (w + 5)
    scored = chunks.withColumn("fifths", fifths(F.col("title"), F.col("body"), wanted))
    score = saturate(F.col("fifths"))
    hit = F.col("fifths") > 0
    if corrected:
        scored = scored.withColumn("more", fifths(F.col("title"), F.col("body"), corrected))
        score, hit = score + 0.5 * saturate(F.col("more")), hit | (F.col("more") > 0)
    return scored.filter(hit).withColumn("score", score)


def best_chunks(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The best chunk of each (element_id, site_id); the `limit` best of those, with rank. Ties: smaller chunk, element, site."""
    w = Window.partitionBy("element_id", "site_id").orderBy(F.desc(score), "chunk")
    best = scored.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    top = best.orderBy(F.desc(score), "element_id", "site_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "element_id", "site_id")))


def postings(chunks: DataFrame) -> DataFrame:
    """(element_id, site_id, chunk, lexeme, pos, weight)."""
    words = lambda c, w: F.struct(F.lit(w).alias("weight"), text.lexemes(F.coalesce(F.col(c), F.lit(""))).alias("words"))
    each = chunks.select("element_id", "site_id", "chunk", F.inline(F.array(words("title", "A"), words("body", "B"))))
    return each.select("element_id", "site_id", "chunk", "weight", F.posexplode("words").alias("pos", "lexeme")).select("element_id", "site_id", "chunk", "lexeme", (F.col("pos") + 1).alias("pos"), "weight")


def posting_lists(chunks: DataFrame) -> DataFrame:
    """(bucket, lexeme, occurrences, hits), hits of (element_id, site_id, section_id, chunk, weight in fifths). A chunk's words all lie in its row, so nothing is shuffled."""
    title, body = (text.lexemes(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body"))
    rows = chunks.select("element_id", "site_id", "section_id", "chunk", title.alias("title"), body.alias("body"))
    return inverted.invert(rows, "lexeme", {"title": TITLE_FIFTHS, "body": BODY_FIFTHS})


def trigram_lists(terms: DataFrame) -> DataFrame:
    """(bucket, gram, occurrences, hits), hits of (term, df, weight)."""
    return inverted.invert(terms.select("term", "df", F.array_distinct(scalar.trigrams(F.col("term"))).alias("grams")), "gram", {"grams": 1})


def posting_scores(postings: DataFrame, wanted: list[str], corrected: list[str] | None = None, site_id: int | None = None, sections: list[int] | None = None) -> DataFrame:
    """(element_id, site_id, section_id, chunk, fifths, score) of the chunks that hit, from postings of the terms: w / (1 + w), and half of the same for the corrected expression."""
    if site_id is not None:
        postings = postings.filter(F.col("site_id") == site_id)
    if sections is not None:
        postings = postings.filter(F.col("section_id").isin(sections))
    part = lambda terms: F.coalesce(F.sum(F.when(F.col("lexeme").isin(terms), F.col("fifths"))), F.lit(0)) if terms else F.lit(0)
    hit = postings.groupBy("element_id", "site_id", "section_id", "chunk").agg(part(wanted).alias("fifths"), part(corrected or []).alias("more"))
    saturate = lambda w: w / (w + 5)
    return hit.withColumn("score", saturate(F.col("fifths")) + 0.5 * saturate(F.col("more"))).filter("score > 0").drop("more")


def close_terms(lexemes: list[str], terms: DataFrame, grams: DataFrame, edit_limit: bool = True) -> DataFrame:
    """(raw, lexeme, term, sim, df): variants() for a query's lexemes, given the stored rows of those terms and of their trigrams.

    The query's side is literals. Length and edit distance are tested on each row as it is read, so only close terms are grouped.
    """
    spark = terms.sparkSession
    lex = spark.createDataFrame([(x, x) for x in dict.fromkeys(lexemes)], "raw string, lexeme string")
    exact = F.broadcast(lex).join(terms, F.col("term") == F.col("lexeme")).select("raw", "lexeme", "term", F.lit(1.0).alias("sim"), "df")
    unknown = lex.filter(F.length("lexeme") >= LEAST_TOKEN).join(exact.select("raw"), "raw", "left_anti")
    left = unknown.select("raw", "lexeme", F.explode(F.array_distinct(scalar.trigrams(F.col("lexeme")))).alias("gram"))
    near = F.lit(True)
    if edit_limit:
        cap = scalar.edit_cap(F.col("lexeme"))
        near = (F.abs(F.length("term") - F.length("lexeme")) <= cap) & (F.levenshtein("term", "lexeme") <= cap)
    # One conditional expression: wherever the optimiser moves it, the dear parts are only worked out for terms that passed the cheap ones.
    sim = F.when(near, F.when(scalar.similarity(F.col("lexeme"), F.col("term")) >= TRIGRAM_GATE, scalar.word_similarity(F.col("lexeme"), F.col("term"))))
    close = grams.join(F.broadcast(left), "gram").select("raw", "lexeme", "term", sim.alias("sim"), "df").filter(F.col("sim") >= LEAST_SIMILARITY).distinct()
    both = exact.unionByName(close.select("raw", "lexeme", "term", "sim", "df"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("sim"), F.desc("df"), "term"))).filter(F.col("n") <= MOST_VARIANTS).drop("n")


def dictionary(chunks: DataFrame, least: int = 3) -> DataFrame:
    """(term, df): occurrences of every lexeme of at least `least` characters. One shuffle, after partial counts."""
    words = F.concat(text.lexemes(F.coalesce("title", F.lit(""))), text.lexemes(F.coalesce("body", F.lit(""))))
    return chunks.select(F.explode(F.filter(words, lambda x: F.length(x) >= least)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def merge_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of both; nothing is ever taken back."""
    return old.unionByName(new).groupBy("term").agg(F.sum("df").alias("df"))


def variants(tokens: DataFrame, terms: DataFrame, edit_limit: bool = True) -> DataFrame:
    """(raw, lexeme, term, sim, df): each token's best dictionary term: itself if known, else the most similar.

    The similarity join goes by shared trigrams: terms and unknown tokens meet in a hash join on a trigram, and only those pairs are
    measured. A pair over the similarity gate shares a trigram, so nothing is lost, and no pair of unlike words is built.
    """
    lex = tokens.select(F.col("raw"), F.lower("raw").alias("lexeme")).distinct()
    exact = lex.join(terms, F.col("term") == F.col("lexeme")).select("raw", "lexeme", "term", F.lit(1.0).alias("sim"), "df")
    unknown = lex.join(exact.select("raw"), "raw", "left_anti").filter(F.length("lexeme") >= LEAST_TOKEN)
    left = unknown.select("raw", "lexeme", F.explode(F.array_distinct(scalar.trigrams(F.col("lexeme")))).alias("gram"))
    # A term is at most so much longer or shorter as the gate allows: shared / all >= gate bounds the sizes' ratio.
    right = terms.select("term", "df", F.explode(F.array_distinct(scalar.trigrams(F.col("term")))).alias("gram"))
    pairs = left.join(right, "gram").groupBy("raw", "lexeme", "term", "df").agg(F.count("*").alias("shared"))
    if edit_limit:
        cap = scalar.edit_cap(F.col("lexeme"))
        pairs = pairs.filter((F.abs(F.length("term") - F.length("lexeme")) <= cap) & (F.levenshtein("term", "lexeme") <= cap))
    close = pairs.filter(scalar.similarity(F.col("lexeme"), F.col("term")) >= TRIGRAM_GATE).withColumn("sim", scalar.word_similarity(F.col("lexeme"), F.col("term"))).filter(F.col("sim") >= LEAST_SIMILARITY)
    both = exact.unionByName(close.select("raw", "lexeme", "term", "sim", "df"))
    w = Window.partitionBy("raw").orderBy(F.desc("sim"), F.desc("df"), "term")
    return both.withColumn("n", F.row_number().over(w)).filter("n <= 1").drop("n")


def language(locale: Column) -> Column:
    """The text search configuration of a locale such as de-CH; 'simple' for those without one."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LOCALES.items() for x in kv)), F.element_at(F.split(F.lower(locale), "[-_]"), 1)), F.lit("simple"))


def clean_tokens(query: str) -> list[str]:
    """Distinct clean lexemes of at least two characters, in order."""
    return [x for x in dict.fromkeys(_JUNK.sub("", w) for w in query.lower().split()) if len(x) >= 2]


def search_lexemes(query: str) -> list[str]:
    """What a plain search looks for: the lexemes of every token. Tokens are joined by OR before any operator is read, so a negated
    token adds no score, and neither does the word `or`."""
    return list(dict.fromkeys(x for w in query.lower().split() if not w.startswith("-") and w != "or" for x in _WORD.findall(w)))


def corrected_lexemes(query: str, found: dict[str, str], enabled: bool = True) -> list[str]:
    """All lexemes of the corrected expression, given each token's best term; none if nothing was corrected, or the query has quotes or operators."""
    if not enabled or '"' in query or "-" in query:
        return []
    tokens = clean_tokens(query)
    more = [found[t] for t in tokens if found.get(t, t) != t]
    return list(dict.fromkeys([*tokens, *more])) if more else []


def rewrite(query: str, found: dict[str, str], enabled: bool = True) -> str | None:
    """The corrected expression as text; None if there is none."""
    if not corrected_lexemes(query, found, enabled):
        return None
    return " | ".join(f"({t} | {found[t]})" if found.get(t, t) != t else t for t in clean_tokens(query))
