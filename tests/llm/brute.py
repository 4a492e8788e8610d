"""Plain versions of the operators, for comparison on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen, at = collections.Counter(tri), set()
    for i, x in enumerate(tri):
        if seen[x] > 1:
            at |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at)


def base_spans(text):
    out = []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def crc(ids):
    return zlib.crc32(packed(ids))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_components(docs):
    """id -> (set size, smallest id reached), by comparing all pairs of sets."""
    sets = {i: shingles(t) for i, t in docs}
    first = {i: i for i in sets}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                first[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def top_k(rows, k=10):
    """(id, whole-number vector) -> (query, rank, id, score) for ids that 100 divides."""
    out = []
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-int(np.dot(v, x)), i) for i, x in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)
