"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text) -> frozenset:
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard_components(rows, percent=80):
    """rows: (doc_id, text). [(doc_id, n_shingles, component_id)]"""
    sets = [shingle_set(t) for _, t in rows]
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            classes[s].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    reps = [own[0] for own in classes.values()]
    for own in classes.values():
        for i in own:
            up[root(i)] = root(own[0])
    where = defaultdict(list)
    for i in reps:
        common = defaultdict(int)
        for x in sets[i]:
            for j in where[x]:
                common[j] += 1
            where[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def contained_items(docs, items, percent=80):
    out = []
    its = [(i, shingle_set(t)) for i, t in items]
    for d, t in docs:
        s = shingle_set(t)
        for i, x in its:
            if x and 100 * len(x & s) >= percent * len(x):
                out.append((d, i, len(x), len(x & s)))
    return out


def repeated_bytes(rows, n=400):
    """rows: (doc_id, text). Mask of removed bytes per row, every n-byte string looked up."""
    data = [(t or "").encode() for _, t in rows]
    count = defaultdict(int)
    for b in data:
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] += 1
    masks = []
    for b in data:
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                m[i : i + n] = b"\x01" * n
        masks.append(m)
    return masks
