"""Suffix sorting of one shard by external induced sorting.

Suffixes are (position) tuples in queues ordered by first character and arrival. An induction takes the least queue,
and hands each of its suffixes' predecessors to the queue of their own character. Queues past the memory bound go to
disk in runs and come back in order. The order of the leftmost S-type suffixes, which starts the last induction, comes
from a first induction (which sorts and names the substrings between them) and the ranking of the reduced string.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueues:
    """First-in first-out queues of positions, one for each character; runs past ``memory`` bytes lie on disk."""

    def __init__(self, characters: int, memory: int):
        self.memory, self.held = memory, 0
        self.runs: list[list] = [[] for _ in range(characters)]
        self.file = None

    def push(self, characters: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(characters, kind="stable")
        characters, positions = characters[order], positions[order]
        cut = np.flatnonzero(np.diff(characters, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(characters)], strict=True):
            self.runs[int(characters[a])].append(positions[a:b])
        self.held += positions.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")
        self.file.seek(0, 2)
        for runs in self.runs:
            for i, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    at = self.file.tell()
                    self.file.write(run.tobytes())
                    runs[i] = (at, len(run), run.dtype)
        self.held = 0

    def pop(self, character: int) -> np.ndarray:
        """All positions that wait under the character, in order of arrival."""
        out = []
        for run in self.runs[character]:
            if isinstance(run, tuple):
                at, count, kind = run
                self.file.seek(at)
                run = np.frombuffer(self.file.read(count * np.dtype(kind).itemsize), kind)
            else:
                self.held -= run.nbytes
            out.append(run)
        self.runs[character] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one counts as S."""
    n = len(text)
    out = np.zeros(n, bool)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    nonzero = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nonzero[::-1])[::-1]
    rising = np.append(step > 0, True)
    out[: n - 1] = rising[nearest]
    out[n - 1] = True
    return out


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, characters: int, memory: int) -> np.ndarray:
    """Positions in suffix order (at least by the substrings up to the next LMS one), from LMS positions in order."""
    larger, smaller = BucketQueues(characters, memory), BucketQueues(characters, memory)
    seeds = BucketQueues(characters, memory)
    seeds.push(text[lms], lms)
    l_parts: list[np.ndarray] = []

    def l_before(at):
        before = at[at > 0] - 1
        before = before[~s_type[before]]
        larger.push(text[before], before)

    for c in range(characters):
        layers = []
        while len(layer := larger.pop(c)):
            layers.append(layer)
            l_before(layer)
        l_parts.append(np.concatenate(layers) if layers else np.zeros(0, np.int32))
        l_before(seeds.pop(c))

    out: list[np.ndarray] = []

    def s_before(at):
        before = at[at > 0] - 1
        before = before[s_type[before]]
        smaller.push(text[before], before)

    last = np.array([len(text) - 1], np.int32)
    smaller.push(text[last], last)
    for c in range(characters - 1, -1, -1):
        layers = []
        while len(layer := smaller.pop(c)):
            layers.append(layer)
            s_before(layer)
        if layers:
            out.append(np.concatenate(layers)[::-1])
        if len(l_parts[c]):
            out.append(l_parts[c])
            s_before(l_parts[c][::-1])
        l_parts[c] = None
    for q in (larger, smaller, seeds):
        q.close()
    return np.concatenate(out[::-1])


def rank_reduced(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by doubling, until all differ or ``depth`` names are compared."""
    rank, span = names.astype(np.int64), 1
    n = len(rank)
    while span < depth:
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new)
        span *= 2
        if rank[order[-1]] == n - 1:
            break
    return rank


def suffix_order(text: np.ndarray, characters: int, depth: int, memory: int = 64 << 20) -> np.ndarray:
    """Suffixes of ``text`` ordered by their first ``depth`` characters at least.

    ``text`` holds small integers below ``characters`` and ends with a 0 that stands nowhere else.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    s_type = s_types(text)
    is_lms = s_type.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        rough = induce(text, s_type, lms, characters, memory)
        ordered = rough[is_lms[rough]]
        number = np.zeros(n, np.int32)
        number[lms] = np.arange(len(lms))
        nth = number[ordered]
        end = np.append(lms[1:], n - 1)
        size = end[nth] - ordered
        same = size[1:] == size[:-1]
        pair = np.flatnonzero(same)
        a, b, left = ordered[pair], ordered[pair + 1], size[pair]
        for j in range(int(left.max()) + 1 if len(left) else 0):
            live = left >= j
            if not live.all():
                keep = np.flatnonzero(live)
                a, b, left, pair = a[keep], b[keep], left[keep], pair[keep]
            wrong = text[a + j] != text[b + j]
            if wrong.any():
                same[pair[wrong]] = False
                keep = np.flatnonzero(~wrong)
                a, b, left, pair = a[keep], b[keep], left[keep], pair[keep]
            if not len(a):
                break
        named = np.zeros(len(lms), np.int64)
        named[nth] = np.concatenate([[0], np.cumsum(~same)])
        rank = rank_reduced(named, depth // 2 + 1)
        lms = lms[np.argsort(rank, kind="stable")]
    return induce(text, s_type, lms, characters, memory)


def shares_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes at ``a`` and ``b`` are equal, eight at a time; ``data`` must reach that far."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    wide = np.ascontiguousarray(words).view(np.uint64).ravel()
    alike = np.ones(len(a), bool)
    live = np.arange(len(a))
    for j in [*range(0, length - 7, 8), length - 8]:
        ok = wide[a[live] + j] == wide[b[live] + j]
        alike[live[~ok]] = False
        live = live[ok]
    return alike
