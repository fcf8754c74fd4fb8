"""Brute-force versions and fixtures of the training-data operators."""
import collections
import hashlib
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(docs, k, percent):
    """docs: (doc_id, text) -> {(doc_id, n_shingles, component_id)}, all pairs."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    u = Union(range(len(sets)))
    where = collections.defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(i)
    seen = set()
    for s in where.values():
        s = sorted(s)
        for i, a in enumerate(s):
            for b in s[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    inter = len(sets[a][1] & sets[b][1])
                    if 100 * inter >= percent * len(sets[a][1] | sets[b][1]):
                        u.join(a, b)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = u.find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, len(s), low.get(u.find(i))) for i, (d, s) in enumerate(sets)]


def dedup_substrings(docs, window=20):
    """docs: (doc_id, text) with distinct ids -> [(doc_id, n_words, n_removed, kept text)]."""
    out, first = [], set()
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if x in first:
                gone[i:i + window] = [True] * window
            first.add(x)
        out.append((d, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)))
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    found = []
    for kind, p in PII.items():
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def pii_row(doc_id, text):
    f = base_pii(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in f)
    n = collections.Counter(k for k, _, _ in f)
    return (doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined)
