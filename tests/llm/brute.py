"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(text):
    out, n = [], {}
    for kind, (pat, ok) in PII.items():
        got = [(m.start(), m.end()) for m in pat.finditer(text or "") if ok(m.group())]
        n[kind] = len(got)
        out += [f"{kind}:{a}:{b}" for a, b in got]
    return n, sha(",".join(out))


def disclosing_terms(texts, threshold=0.8, min_given=0.5, least=3, words=6, width=64):
    """Terms by the mutual information with an e-mail, for texts of plain words without copies and one address at most."""
    near, holders, addresses = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        for w in set(re.findall(r"[a-z0-9]+", t.lower())):
            holders[w].add(d)
        for m in PII["email"][0].finditer(t):
            addresses[m.group()].add(d)
            left, right = t[max(0, m.start() - width) : m.start()], t[m.end() : m.end() + width]
            left = left if m.start() <= width else left.split(" ", 1)[-1]
            right = right if len(t) - m.end() <= width else right.rsplit(" ", 1)[0]
            plain = lambda x: [w for w in x.lower().split() if w.isalpha()]
            for w in plain(left)[-words:] + plain(right)[:words]:
                if len(w) > 3:
                    near[m.group(), w].add(d)
    out = set()
    for (e, w), ds in near.items():
        given, p = len(ds) / len(holders[w]), len(addresses[e]) / len(texts)
        if len(ds) >= least and given >= min_given and 1 - math.log(given) / math.log(p) >= threshold:
            out.add(w)
    return out


def quality(text):
    t = text or ""
    w = WS.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WS.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_rule(host, path, rules):
    best = None
    for v, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = v, h + p
    return best


def targets(sizes):
    """sizes: {source: words}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        spare = total - sum(fixed.values())
        t = {s: spare * w[s] / max(1, sum(w[x] for x in left)) for s in left}
        over = [s for s in left if t[s] > 2 * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: 2 * sizes[s] for s in over}


def schedule(targets, block):
    """{source: [slot of each rank]} of the golden-ratio schedule."""
    order = sorted(targets, key=lambda s: (s is None, s or ""))
    total, n = sum(targets[s] for s in order), 0
    bounds, at = [], 0.0
    for s in order:
        at += targets[s]
        bounds.append(at / total)
    out = {s: [] for s in order}
    n = math.ceil(total / block)
    for i in range(n):
        u = (i + 0.5) * 0.6180339887498949 % 1
        out[next((s for s, hi in zip(order, bounds, strict=True) if u < hi), order[-1])].append(i)
    for s in order:
        for _ in range(len(out[s]), math.ceil(round(targets[s]) / block)):
            out[s].append(n)
            n += 1
    return out


def pieces(slots, goal, size, block):
    """(slot, from, to) on a source's line, which is laid twice."""
    for rank, slot in enumerate(slots):
        a, b = rank * block, min(rank * block + block, goal)
        for k in (0, 1):
            x, y = max(a, k * size), min(b, k * size + size)
            if x < y:
                yield slot, x - k * size, y - k * size


def conversations(rows):
    """rows: (conv_id, turn, role, text)"""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss)
    return out


def contamination(docs, items):
    """docs: {id: text}, items: {id: text} -> {id: (n_words, n_hit, item ids)}"""
    windows = defaultdict(set)
    for k, t in items.items():
        w = ALNUM.findall(lower(t))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(k)
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs.items():
        w = ALNUM.findall(lower(t))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= got
        out[d] = len(w), len(hit), sorted(map(str, ids))
    return out


def near_duplicates(docs, n=3, percent=85):
    """docs: {id: text} -> {id: (set size, component)}"""
    sets = {}
    for d, t in docs.items():
        w = WS.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d, s in sets.items():
        common = Counter(o for g in s for o in holders[g] if o > d)
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(sets[d]), root(d)) for d in docs}


def repeats(docs, length=400):
    """docs: {id: text} -> {id: (bytes, removed, spans, sha of the rest)}"""
    seen, data = Counter(), {d: (t or "").encode() for d, t in docs.items()}
    for b in data.values():
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
