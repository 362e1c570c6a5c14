import re
from urllib.parse import urlsplit

from seamark.llm import op1_urlfilter as op

PAGES = "page_id long, url string, key string, part int, verdict string, kind int"
URLS = [
    "http://example.com/a", "https://EXAMPLE.com:8080/a#frag", "http://user:pw@sub.example.com./x?y=1", "http://www.example.com", "http://example.community/", "ftp://other.org/p/q", "http://other.org/p/qq", "http://other.org/p",
    None, "", "no url", "http:///path", "http://example.com/a", "http://example.com/" + "x" * 50_000, "http://b.ünï.org/ä", "http://example.com?q", "http://x.other.org/p/q/r",
]
RULES = [
    (1, "block", "domain", "example.com"), (2, "allow", "host", "www.example.com"), (3, "block", "prefix", "other.org/p/q"), (4, "allow", "domain", "org"), (5, "allow", "domain", "example.com"), (6, "block", "host", "other.org"),
    (7, "block", "prefix", "example.com/a"), (8, "block", "domain", None), (None, "block", "domain", "org"), (9, None, "domain", "org"), (10, "block", "domain", ""), (11, "block", "domain", "ünï.org"), (12, "block", "prefix", "other.org/p/q"), (13, "allow", "domain", "sub.example.com"),
]


def key_of(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
    host = m and re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[1].lower())))
    return ",".join(reversed(host.split("."))) + "," + ("" if m[2].startswith("/") else "/") + m[2] if host else None


def expected(urls, rules):
    keyed = []
    for i, action, kind, pattern in rules:
        if i is None or action is None or not pattern:
            continue
        host, _, path = pattern.partition("/")
        keyed.append((",".join(reversed(host.lower().split("."))) + "," + {"domain": "", "host": "/", "prefix": "/" + path}[kind], i, action))
    out = []
    for n, url in enumerate(urls):
        key = key_of(url)
        hits = sorted(((len(k), a == "block", -i, i, a) for k, i, a in keyed if key is not None and key.startswith(k)), reverse=True)
        out.append((n, key, hits[0][4] if hits else "allow", hits[0][3] if hits else None, len(hits)))
    return sorted(out)


def run(spark, urls, rules, parts):
    pages = spark.createDataFrame([(n, u, "k", 1, "v", 2) for n, u in enumerate(urls)], PAGES)
    df = op.filter_urls(pages, spark.createDataFrame(rules, "rule_id long, action string, kind string, pattern string"), parts)
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    assert urlsplit(URLS[0]).hostname == "example.com"
    for parts in (1, 7):
        assert run(spark, URLS * 3, RULES, parts) == expected(URLS * 3, RULES)


def test_empty_tables(spark):
    assert run(spark, [], RULES, 3) == []
    assert {r[2] for r in run(spark, URLS, [], 3)} == {"allow"}


def test_null_ids_and_repeats(spark):
    pages = spark.createDataFrame([(None, "http://example.com/"), (1, "http://example.com/"), (1, "http://example.com/")], "page_id long, url string")
    got = op.filter_urls(pages, op.default_rules(spark)).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "None"] and {r["rule_id"] for r in got} == {8}
