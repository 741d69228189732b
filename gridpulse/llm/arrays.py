"""Texts of an Arrow batch as flat numpy arrays: words, hashes and packed columns."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

NULL_ID = -(2**63)
LONG_WORD = 64

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
"""Separators of the word pattern ``[^\\x20\\x09-\\x0D]+``."""

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the offsets of each (nulls are empty), without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch | pa.Table, column: str, most: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with about ``most`` bytes of ``column`` at most; one longer text stays whole."""
    if batch.num_rows:
        yield from slices(batch, flat(batch.column(column))[1], most)


def slices(batch: pa.RecordBatch | pa.Table, offsets: np.ndarray, most: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows whose sizes, the steps of ``offsets``, add up to ``most`` at most; one larger row stays whole."""
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a flat buffer: ``starts`` and ``ends`` in bytes, ``first[i]:first[i + 1]`` are those of text ``i``."""

    def __init__(
        self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = ASCII_SPACE, cuts: np.ndarray | None = None
    ):
        """``cuts``: byte positions that start a new word in any case."""
        word = ~separators[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        if cuts is not None:
            edge[cuts] = True
        before = np.zeros(len(buf), dtype=bool)
        before[1:] = word[:-1]
        after = np.zeros(len(buf), dtype=bool)
        after[:-1] = word[1:]
        self.buf = buf
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def text(self, i: int) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are walked byte by byte together, longest first."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(size > LONG_WORD)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    short = np.minimum(size, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1][len(long) :]
    at, counts = starts[order], np.bincount(short, minlength=LONG_WORD + 2)[: LONG_WORD + 1]
    active = len(order) - np.cumsum(counts)
    h = short[order].astype(np.uint64)
    for j in range(LONG_WORD):
        n = int(active[j])
        if not n:
            break
        h[:n] = (h[:n] ^ buf[at[:n] + j]) * _BASE
        h[:n] ^= h[:n] >> np.uint64(29)
    out[order] = mix(h)
    return out


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive units of an array of 64-bit values."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(units) - n + 1, np.uint64)
    factor = 0xD6E8FEB86659FD93
    for j in range(n):
        total += units[j : len(units) - n + 1 + j] * np.uint64(factor)
        factor = factor * int(_BASE) % 2**64
    return mix(total)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total`` positions start ``n`` units that stay inside their text (texts cut by ``first``)."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total) + n <= ends[:total] if total else np.zeros(0, bool)


def packed(groups: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Rows of equal group number as one row of raw column bytes each."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    cut = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else np.zeros(0, int)
    ends = np.append(cut[1:], len(groups))
    out = {}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    return groups[cut], out


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """All rows of a packed column, end to end."""
    buf, _ = flat(column)
    return np.frombuffer(buf.tobytes(), kind)


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids; a null is the smallest long."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def trim() -> None:
    """Gives freed memory back to the system: workers outlive their task, and the next may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(task):
    """The task function, trimming its worker when it ends."""

    def rows(batches):
        try:
            yield from task(batches)
        finally:
            trim()

    def one(table):
        try:
            return task(table)
        finally:
            trim()

    def two(left, right):
        try:
            return task(left, right)
        finally:
            trim()

    if inspect.isgeneratorfunction(task):
        return rows
    return two if len(inspect.signature(task).parameters) == 2 else one
