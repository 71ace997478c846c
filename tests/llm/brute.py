"""Plain Python answers to compare the operators with."""

import re
from collections import Counter, defaultdict


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def similar_pairs(sets, percent):
    """Pairs of keys whose sets have 100 * intersection >= percent * union."""
    often = Counter(x for s in sets.values() for x in s)
    holders = defaultdict(list)
    for key, own in sets.items():
        rare = sorted(own, key=lambda x: (often[x], x))
        seen = set()
        for x in rare[: len(rare) - -(-percent * len(rare) // 100) + 1]:
            for other in holders[x]:
                if other not in seen:
                    seen.add(other)
                    if 100 * len(own & sets[other]) >= percent * len(own | sets[other]):
                        yield other, key
            holders[x].append(key)


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False))


def near_duplicates(docs, k, percent):
    """doc_id: (n_shingles, component)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    groups = Sets(sorted(docs))
    for a, b in similar_pairs({i: s for i, s in sorted(sets.items()) if s}, percent):
        groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in docs}


def compared(line):
    return re.sub(r"\s+", " ", line.lower()).strip()


def first_lines(docs, percent=80, k=5, least=20):
    """(doc_id, line): the first (doc_id, line) of its component."""
    lines = {(i, n): compared(x) for i, t in docs.items() if t is not None for n, x in enumerate(t.split("\n"))}
    texts = sorted({v for v in lines.values() if len(v) >= least})
    groups = Sets(texts)
    for a, b in similar_pairs({u: frozenset(u[i : i + k] for i in range(len(u) - k + 1)) for u in texts}, percent):
        groups.join(a, b)
    first = {}
    for at in sorted(lines):
        if len(lines[at]) >= least:
            first.setdefault(groups.find(lines[at]), at)
    return {at: first[groups.find(v)] if len(v) >= least else at for at, v in lines.items()}


def bare_words(text):
    return [re.sub(r"^\W+|\W+$", "", w) or w for w in (text or "").lower().split()]


def exact_overlaps(docs, items, n):
    """(doc_id, item_id) that have n equal words in a row."""
    held = defaultdict(set)
    for i, t in items.items():
        w = bare_words(t)
        for p in range(len(w) - n + 1):
            held[tuple(w[p : p + n])].add(i)
    out = set()
    for d, t in docs.items():
        w = bare_words(t)
        for p in range(len(w) - n + 1):
            out |= {(d, i) for i in held.get(tuple(w[p : p + n]), ())}
    return out
