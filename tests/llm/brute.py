"""Plain answers to compare with, written without the operators' helpers."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, size):
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(docs, size, threshold):
    """{doc_id: (n_shingles, component)} for distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    common = defaultdict(int)
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
