"""Brute-force versions of the corpus operators."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}]+")


def components(pairs):
    """The smallest id of each connected component for its other members."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up) if find(x) != x}


def simhash_plain(text):
    """(64 bits by words, 128 bits by word pairs), in plain integers; None without words."""
    from seamark.llm.op2_simhash import PUNCTUATION, WEIGHT

    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    words = [w for w in (x.strip(PUNCTUATION) for x in ascii_words(text.lower())) if w]
    if not words:
        return None
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    pack = lambda votes: sum(1 << (63 - b) for b in range(64) if sum(n if x >> (63 - b) & 1 else -n for x, n in votes) > 0)
    one = pack([(x, round(WEIGHT * math.sqrt(n))) for x, n in Counter(h).items()])
    two = [mix((a * 0x9E3779B97F4A7C15 + b) & full) for a, b in zip(h, h[1:])] or [mix(h[0])]
    return one, pack([(x, 1) for x in two]) << 64 | pack([(mix(x + 1 & full), 1) for x in two])


def near_duplicates(rows, search=11, confirm=34):
    """rows: (doc_id, text)."""
    made = {t: simhash_plain(t) for t in {t for i, t in rows if i is not None and t is not None}}
    known = sorted({(i, *made[t]) for i, t in rows if i is not None and t is not None and made[t]})
    ids = [x[0] for x in known]
    f = np.array([[x[1], x[2] >> 64, x[2] & (1 << 64) - 1] for x in known], np.uint64).reshape(-1, 3)
    pairs = []
    for a in range(len(ids)):
        far = np.bitwise_count(f[a, 0] ^ f[a + 1 :, 0])
        other = np.bitwise_count(f[a, 1:] ^ f[a + 1 :, 1:]).sum(1)
        pairs += [(ids[a], ids[b + a + 1]) for b in np.flatnonzero((far <= search) & (other <= confirm))]
    return components(pairs)


def windows(rows, least):
    """{doc_id: {(row, start)}} of windows that two documents have, as merged (doc_id, start, end)."""
    by = defaultdict(set)
    for i, t in rows:
        w = ascii_words(t)
        for k in range(len(w) - least + 1):
            by[tuple(w[k : k + least])].add((i, k))
    spans = defaultdict(set)
    for places in by.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                spans[i].add(k)
    out = set()
    for i, starts in spans.items():
        begin = last = None
        for k in sorted(starts):
            if last is None or k > last + least:
                if last is not None:
                    out.add((i, begin, last + least))
                begin = k
            last = k
        out.add((i, begin, last + least))
    return out


def ascii_words(t):
    return [x for x in regex.split(r"[ \t\n\r\f\v]+", t) if x]


def normal_line(x):
    return regex.sub(r"[ \t\r\f]+", " ", x).strip(" ").lower()


def dedup_lines(rows, share, least):
    """[(text, dropped)] for rows of (doc_id, text)."""
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if normal_line(x):
                docs[normal_line(x)].add(i)
    hot = {x for x, d in docs.items() if len(d) > least and len(d) > share * len({i for i, _ in rows})}
    out = []
    for _, t in rows:
        lines = None if t is None else t.split("\n")
        kept = lines and [x for x in lines if normal_line(x) not in hot]
        out.append((None, 0) if t is None else ("\n".join(kept), len(lines) - len(kept)))
    return out


def contamination(rows, items, n=13):
    """Set of (doc_id, item_id, start, end, words)."""
    passages = defaultdict(set)
    for item, t in items:
        w = [x.lower() for x in WORD.findall(t or "")]
        for k in range(max(1, len(w) - n + 1) if w else 0):
            passages[tuple(w[k : k + n])].add(item)
    lengths = {len(p) for p in passages}
    out = set()
    for i, t in rows:
        found = list(WORD.finditer(t or ""))
        w = [m.group().lower() for m in found]
        hits = defaultdict(set)
        for k in range(len(w)):
            for m in lengths:
                for item in passages.get(tuple(w[k : k + m]), ()) if k + m <= len(w) else ():
                    hits[item] |= {(k, k + m)}
        for item, spans in hits.items():
            s = e = None
            for a, b in sorted(spans):
                if e is None or a > e:
                    if e is not None:
                        out.add((i, item, found[s].start(), found[e - 1].end(), e - s))
                    s, e = a, b
                e = max(e, b)
            out.add((i, item, found[s].start(), found[e - 1].end(), e - s))
    return out


def topic(t):
    for name, p in (("legal", r"(Licensed|licensed|License|rights reserved)"), ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"), ("tabular", r" [|] "), ("numeric", r"[0-9]{6}")):
        if regex.search(p, t or ""):
            return name
    return "prose"


def tokens(t):
    return -(-len((t or "").encode()) // 4)


def mixed(rows, targets):
    """Kept rows of (doc_id, text, lang, source), by raking with plain dictionaries and a scale found by bisection."""
    none = "(none)"
    cell = lambda r: (r[3] or none, r[2] or none, topic(r[1]))
    size = Counter()
    for r in rows:
        size[cell(r)] += tokens(r[1])
    total = sum(size.values())
    goals = []
    for k, named in enumerate((targets.source, targets.lang, targets.topic)):
        sums = Counter()
        for c, n in size.items():
            sums[c[k]] += n
        named = {v: x for v, x in named.items()}
        goal = {v: named[v] for v in sums if v in named and sums[v]}
        rest = {v: n**targets.temper for v, n in sums.items() if v not in named and n}
        left = max(0, 1 - sum(named.values()))
        if rest and left < targets.rest:
            goal, left = {v: x * (1 - targets.rest) for v, x in goal.items()}, targets.rest
        for v, x in rest.items():
            goal[v] = left * x / sum(rest.values())
        whole = sum(goal.values())
        goals.append({v: x / whole for v, x in goal.items()})
    w = {c: n / total for c, n in size.items()}
    for _ in range(targets.rounds):
        off = 0
        for k, goal in enumerate(goals):
            now = Counter()
            for c, x in w.items():
                now[c[k]] += x
            off = max([off, *(abs(now[v] - goal.get(v, 0)) for v in now)])
            w = {c: x * goal.get(c[k], 0) / now[c[k]] if now[c[k]] else x for c, x in w.items()}
        if off <= targets.tolerance:
            break
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(size[c], mid * x) for c, x in w.items()) < targets.budget * total else (low, mid)
    p = {c: (1 if targets.budget >= 1 and x else min(1, low * x / size[c])) if size[c] else 0 for c, x in w.items()}
    draw = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if tokens(r[1]) and draw(r[0]) < p[cell(r)]], p, goals


def chunks_plain(data):
    """Chunks of bytes by the rolling gear hash, byte by byte."""
    from seamark.llm.op5_chunks import GEAR, LEAST, LOOSE, MOST, NORMAL, STRICT

    out, begin, h = [], 0, -int(GEAR[0]) & 0xFFFFFFFF  # as after many zero bytes
    for k, x in enumerate(data):
        h = ((h << 1) + int(GEAR[x])) & 0xFFFFFFFF
        n = k + 1 - begin
        bits = STRICT if n < NORMAL else LOOSE
        if n >= LEAST and (n == MOST or h >> (32 - bits) == 0):
            out.append(data[begin : k + 1])
            begin = k + 1
    return [*out, data[begin:]] if begin < len(data) else out


def containment(rows, threshold):
    """Set of (doc_id, class_id, contained_in, contains, copies)."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t})
    sets = [frozenset(chunks_plain(t.lower().encode())) for _, t in rows]
    docs = defaultdict(set)
    for (i, _), s in zip(rows, sets):
        docs[s].add(i)
    weight = {s: sum(map(len, s)) for s in docs}
    inside, holds, pairs = Counter(), Counter(), [(i, i) for i, _ in rows]
    where = defaultdict(set)
    for s in docs:
        for c in s:
            where[c].add(s)
    for a in docs:
        for b in set().union(*(where[c] for c in a)) - {a}:
            if min(docs[a]) != min(docs[b]) and sum(map(len, a & b)) >= threshold * weight[a]:
                inside[a] += 1
                holds[b] += 1
                pairs += [(i, j) for i in docs[a] for j in docs[b]]
    pairs += [(i, j) for d in docs.values() for i in d for j in d]
    least = components([p for p in pairs if p[0] != p[1]])
    out = {}
    for i, s in {(i, s) for (i, _), s in zip(rows, sets)}:
        old = out.get(i, (0, 0, 0))
        out[i] = tuple(x + y for x, y in zip(old, (inside[s], holds[s], len(docs[s]) - 1)))
    return {(i, least.get(i, i), *x) for i, x in out.items()}
