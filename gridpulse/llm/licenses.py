"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton of all templates is small and travels with the task. A file streams through it once: after each word the
state and length say how much of the words before stands in a template (matching statistics). Matches that cannot grow
are chained per template, in order on both sides, and the words of the template that a chain covers make its score.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridpulse.llm.arrays import Words, chunks, flat, hash_spans, lean
from gridpulse.llm.spark import texts_of

# Phrases whose places are counted, and the label of each.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Public licence notices, by label.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "creative commons attribution noncommercial 4 0 international license",
    ),
    "cc-by-sa": ("creative commons attribution sharealike 4 0 international license",),
    "cc-by": ("creative commons attribution 4 0 international license",),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "all-rights-reserved": ("all rights reserved",),
}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False
"""Separators of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower case."""

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"
)


class Automaton:
    """Suffix automaton of several token sequences, with the template places of every state."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence):
                last = self._extend(last, token)
                self.places[last].append((number, end))
        for state in sorted(range(len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])
        self.places = [sorted(set(p)) for p in self.places]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def walk(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """State and matched length after each token."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(token, 0)
            length = length + 1 if state else 0
            yield state, length


def chain(matches: Sequence[tuple[int, int, int]], gap: int) -> tuple[int, int, int]:
    """Best chain of (text end, template end, length) with both sides in order and gaps of at most ``gap`` words.

    Gives the template words covered and the first and last word of the chain in the text.
    """
    best: list[tuple[int, int]] = []
    for i, (end, at, size) in enumerate(matches):
        score, start = size, end - size + 1
        for j in range(i - 1, -1, -1):
            e, t, _ = matches[j]
            if end - size - e > gap:
                break
            grown = min(size, at - t, end - e)
            if t < at and grown > 0 and best[j][0] + grown > score:
                score, start = best[j][0] + grown, best[j][1]
        best.append((score, start))
    i = max(range(len(best)), key=lambda k: (best[k][0], -k))
    return best[i][0], best[i][1], matches[i][0]


def scan_task(base: Mapping[str, str], templates: Mapping[str, Sequence[str]], shortest: int, least: float, gap: int):
    phrases = [(label, text.split()) for label, text in base.items()]
    longer = [(label, text.split()) for label, texts in templates.items() for text in texts]
    sequences = phrases + longer
    vocabulary = sorted({w for _, words in sequences for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = [[number[w] for w in words] for _, words in sequences]
    shortest = min([shortest, *map(len, coded)])

    def task(batches):
        automaton = Automaton(coded)
        joined = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        known = Words(joined, np.array([0, len(joined)]))
        hashes = hash_spans(joined, known.starts, known.ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        filtered = np.zeros(1 << 16, bool)
        filtered[hashes & np.uint64(0xFFFF)] = True
        pairs = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for c in coded:
            pairs[c[:-1], c[1:]] = True

        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                buf, offsets = flat(part.column("text"))
                buf = LOWER[buf]
                words = Words(buf, offsets, NOT_WORD)
                h = words.hashes()
                ids = np.full(len(h), -1, np.int32)
                maybe = np.flatnonzero(filtered[h & np.uint64(0xFFFF)])
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                sure = hashes[at] == h[maybe]
                ids[maybe[sure]] = order[at[sure]]
                text = words.text(0)
                linked = np.zeros(max(0, len(ids) - 1), bool)
                both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (text[:-1] == text[1:]))
                linked[both] = pairs[ids[both], ids[both + 1]]
                edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
                begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
                long = stop - begin >= shortest
                found: dict[int, dict[int, list]] = {}
                for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
                    doc = int(text[a])
                    shift = a - int(words.first[doc])
                    states = list(automaton.walk(ids[a:b].tolist()))
                    for i, (state, length) in enumerate(states):
                        grows = i + 1 < len(states) and states[i + 1][1] > length
                        if length < shortest:
                            continue
                        for n, end in automaton.places[state]:
                            whole = n < len(phrases) and end == len(coded[n]) - 1 and length >= len(coded[n])
                            if n < len(phrases):
                                if whole:
                                    found.setdefault(doc, {}).setdefault(n, []).append((shift + i, end, len(coded[n])))
                            elif not grows:
                                found.setdefault(doc, {}).setdefault(n, []).append((shift + i, end, min(length, end + 1)))
                        link = automaton.link[state]
                        while link > 0:  # phrases that end here but are shorter than the match
                            if automaton.length[link] < shortest:
                                break
                            for n, end in automaton.places[link]:
                                if n < len(phrases) and end == len(coded[n]) - 1 and automaton.length[link] >= len(coded[n]):
                                    entry = (shift + i, end, len(coded[n]))
                                    own = found.setdefault(doc, {}).setdefault(n, [])
                                    if not own or own[-1] != entry:
                                        own.append(entry)
                            link = automaton.link[link]
                yield result(part, words, found)

    def result(part, words, found):
        n = part.num_rows
        columns = {k: [None] * n for k in ("first_word", "last_word")}
        columns |= {"n_base": [0] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [[]] * n}
        for doc, by in found.items():
            starts, base_labels, spans = [], set(), []
            for k, matches in by.items():
                label, size = sequences[k][0], len(coded[k])
                if k < len(phrases):
                    matches = sorted(set(matches))
                    starts += [end - size + 1 for end, _, _ in matches]
                    base_labels.add(label)
                    spans += [(label, end - size + 1, end, 1.0) for end, _, _ in matches]
                else:
                    got, first, last = chain(matches, gap)
                    if got >= least * size:
                        spans.append((label, first, last, min(1.0, got / size)))
            if starts:
                columns["first_word"][doc], columns["last_word"][doc] = min(starts), max(starts)
            columns["n_base"][doc] = len(starts)
            columns["base_labels"][doc] = ",".join(sorted(base_labels))
            columns["labels"][doc] = ",".join(sorted(base_labels | {s[0] for s in spans}))
            columns["score"][doc] = max((s[3] for s in spans), default=0.0)
            columns["spans"][doc] = [
                dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in sorted(set(spans))
            ]
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_base": pa.array(columns["n_base"], pa.int64()),
                "first_word": pa.array(columns["first_word"], pa.int64()),
                "last_word": pa.array(columns["last_word"], pa.int64()),
                "base_labels": pa.array(columns["base_labels"], pa.string()),
                "labels": pa.array(columns["labels"], pa.string()),
                "score": pa.array(columns["score"], pa.float64()),
                "spans": pa.array(columns["spans"], span),
            }
        )

    return task


def license_scan(
    docs: DataFrame,
    base: Mapping[str, str] = BASE,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    shortest: int = 3,
    least: float = 0.75,
    gap: int = 12,
) -> DataFrame:
    """One row per row of ``docs``: counted phrases, licence labels, a score and the covered spans.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, counted from 0. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` describe the places of the ``base`` phrases. ``labels`` adds each
    template of which chained matches of at least ``shortest`` words, with gaps of at most ``gap`` words, cover the
    share ``least``. ``score`` is the largest share covered, 0 without a label.

    Null text counts as empty: no words, no labels, score 0. Repeated rows are scanned alike; other columns are ignored;
    an empty table gives an empty result.
    """
    return texts_of(docs).mapInArrow(lean(scan_task(base, templates, shortest, least, gap)), SCHEMA)


def query_rows(scanned: DataFrame) -> DataFrame:
    return scanned.drop("spans")
