"""Plain versions of the corpus operators over small lists of (doc_id, text)."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(docs, k=13):
    first = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def suffix_dedup(docs, length=100):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            key = b[j : j + length]
            first[key] = min(first.get(key, (i, j)), (i, j))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < (i, j):
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    return sorted(out)


def near_duplicates(docs, size=5, threshold=0.8):
    """(doc, class, copy_of, links, copies)."""
    sets, members = {}, defaultdict(list)
    for i, t in docs:
        w = WORD.findall(t or "")
        grams = [tuple(w[j : j + size]) for j in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        sets[i] = frozenset(grams)
        members[sets[i]].append(i)
    reps = {s: min(m) for s, m in members.items()}
    links, parent = defaultdict(int), {r: r for r in reps.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(reps.items())
    for a, (s, r) in enumerate(items):
        for t, q in items[:a]:
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[r] += 1
                links[q] += 1
                x, y = root(r), root(q)
                parent[max(x, y)] = min(x, y)
    return sorted((i, root(reps[s]), reps[s], links[reps[s]], len(members[s])) for i, s in sets.items())


def licence_places(text, base):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for label, phrase in base.items():
        p = phrase.split()
        for j in range(len(w) - len(p) + 1):
            if w[j : j + len(p)] == p:
                starts.append(j)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
