"""Brute-force links and components of word shingles."""

import re
from collections import Counter, defaultdict


def shingles(t, words=5):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def components(rows):
    """rows: (doc_id, text); returns a list of (doc_id, n, component) in their order."""
    sets = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        sets[shingles(t)].append(i)
    distinct = [s for s in sets if s]
    index = defaultdict(list)
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(distinct):
        for j, n in Counter(j for g in s for j in index[g]).items():
            if 100 * n >= 75 * (len(s) + len(distinct[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            index[g].append(i)
    least = defaultdict(list)
    for i, s in enumerate(distinct):
        least[root(i)] += [rows[k][0] for k in sets[s] if rows[k][0] is not None]
    at = {s: min(least[root(i)], default=None) for i, s in enumerate(distinct)}
    return [(d, len(shingles(t)), at[shingles(t)] if shingles(t) else d) for d, t in rows]
