"""The input views of sources.tables in SQL, written on their own for the oracle."""

from ..config import PRICES
from ..sources.tables import NOW, SITES

_P = {m: p for m, p in PRICES.items()}
SITE = "CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 END"

VIEWS = {
    "sites": f"SELECT * FROM (VALUES {', '.join(map(str, SITES))}) AS v(site_id, name, handle, language)",
    "entries": f"""SELECT doc_id AS element_id, {SITE} AS site_id, doc_id % 10 AS section_id, array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:6], ' ') AS title,
      CASE WHEN doc_id % 50 <> 7 THEN '/d/' || doc_id END AS url, CASE WHEN doc_id % 40 = 3 THEN 'disabled' ELSE 'enabled' END AS status,
      TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS updated, text FROM documents""",
    "excluded": f"SELECT doc_id AS element_id, {SITE} AS site_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "chunks": """SELECT element_id, site_id, section_id, title, len(string_split(text, chr(10))) AS chunks, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk, unnest(string_split(text, chr(10))) AS body FROM entries""",
    "vectors": """SELECT v.element_id, e.site_id, e.section_id, v.chunk, v.vector, TIMESTAMP '2024-02-01' - to_days(CAST(v.element_id % 45 AS INTEGER)) AS indexed
      FROM (SELECT vec_id // 4 AS element_id, CAST(vec_id % 4 AS INTEGER) AS chunk, embedding AS vector FROM embeddings) v JOIN entries e USING (element_id)""",
    "history": f"""SELECT event_id AS id, CASE WHEN smart THEN 'smart' ELSE 'aiAnswer' END AS type,
      CASE WHEN k = 99 THEN '' ELSE CASE WHEN k % 5 = 0 THEN '  ' || CASE WHEN k % 3 = 0 THEN upper(w) ELSE w END || ' ' ELSE CASE WHEN k % 3 = 0 THEN upper(w) ELSE w END END END AS query,
      CASE WHEN user_id % 10 <> 0 THEN user_id % 4 + 1 END AS site_id, k % 7 AS results, k AS embedding_tokens, CASE WHEN smart THEN 0 ELSE k * 10 END AS tokens_in, CASE WHEN smart THEN 0 ELSE k * 3 END AS tokens_out,
      CAST(floor(value * 10) AS INTEGER) AS duration_ms, k % 3 = 0 AS cached, event_type = 'error' AS has_error, CASE WHEN event_type = 'error' THEN 'failed ' || k END AS error, ts AS created, user_id,
      k + CASE WHEN smart THEN 0 ELSE k * 13 END AS total_tokens,
      CAST(round(k * {_P['text-embedding-3-small'][0]} / 1e6, 6) + CASE WHEN smart THEN 0 ELSE round(round(k * 10 * {_P['gpt-medium'][0]} / 1e6, 6) + round(k * 3 * {_P['gpt-medium'][1]} / 1e6, 6), 6) END AS DECIMAL(10, 6)) AS cost
      FROM (SELECT *, event_type IN ('view', 'click') AS smart, event_type || ' ' || (k % 20) AS w FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "boosts": """SELECT element_id, site_id, [w[1:2]] AS phrases, element_id % 5 * 0.01 AS weight FROM (SELECT *, regexp_extract_all(lower(title), '[\\pL\\pN_]+') AS w FROM entries) WHERE len(w) >= 3
      UNION ALL SELECT element_id, site_id, [w[1:1], w[3:3]], 0.02 FROM (SELECT *, regexp_extract_all(lower(title), '[\\pL\\pN_]+') AS w FROM entries WHERE element_id % 10 = 0) WHERE len(w) >= 3""",
}
NEEDS = {"chunks": ["entries"], "vectors": ["entries"], "boosts": ["entries"]}
NOW_SQL = f"TIMESTAMP '{NOW}'"


def sql(text: str, *views: str) -> str:
    """text, after WITH clauses for the views it names and those they need. text may begin with further CTEs: `, name AS (...) SELECT`."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + text
