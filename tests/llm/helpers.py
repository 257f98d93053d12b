"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import zlib


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(nodes, links):
    """The smallest node that each can reach."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_components(texts: dict, size: int, percent: int = 80):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                links.append((a, b))
    return components(sets, links), {d: len(s) for d, s in sets.items()}


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0
