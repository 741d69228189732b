"""Exact removal of repeated byte strings through suffix order.

Documents are cut into blocks of windows with one anchor (``blocks``); blocks of one anchor meet in one shard. Blocks
that equal an earlier one are settled whole. The bytes of the others are fetched, strung together and suffix sorted
(``induced``): windows of ``length`` bytes with one content are neighbours in suffix order, and the earliest stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import chunks, flat, lean, mix, unpacked
from gridpulse.llm.blocks import DONE_SCHEMA, KINDS, Spans, locate, merged_groups, repeated_runs, same_row
from gridpulse.llm.induced import shares_prefix, suffix_order

BYTES_SCHEMA = "bucket int, d binary, p binary, n binary, s binary"
TEXT_BYTES = 1 << 20


def byte_units(batch) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = flat(batch.column("text"))
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[buf], offsets


def bytes_of(length: int):
    def make(buckets: int, shift: int):
        def task(docs: pa.Table, asked: pa.Table) -> pa.Table:
            a, d, p, n = (unpacked(asked.column(f"ask_{x}"), KINDS[x]) for x in "adpn")
            parts = []
            if len(d) and docs.num_rows:
                buf, offsets = flat(docs.column("text"))
                row, start = locate(docs, d, p, shift)
                count = n.astype(np.int64) + length - 1
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                s = buf[np.repeat(offsets[row] + start, count) + offset]
                bucket = (a % np.uint64(buckets)).astype(np.int64)
                parts = [(bucket, {"d": d, "p": p, "n": n}), (np.repeat(bucket, count), {"s": s})]
            return pa.Table.from_batches([merged_groups(parts, BYTES_SCHEMA)])

        return task

    return make


def compare_suffixes(length: int, memory: int):
    """Windows of one shard whose bytes start earlier in another of its blocks, as runs."""

    def make(buckets: int, shift: int):
        def task(table: pa.Table) -> pa.Table:
            d, p, n = (unpacked(table.column(x), KINDS[x]) for x in "dpn")
            s = unpacked(table.column("s"), np.uint8)
            if not len(d):
                return pa.Table.from_batches([merged_groups([], DONE_SCHEMA)])
            size = n.astype(np.int64) + length - 1
            begin = np.cumsum(size + 1) - size - 1
            # bytes are 2 to 257, 1 ends a block, 0 ends the shard
            text = np.ones(int((size + 1).sum()) + 1, np.int16)
            text[-1] = 0
            block = np.repeat(np.arange(len(d), dtype=np.int32), size)
            at = np.arange(len(s)) + block
            text[at] = s.astype(np.int16) + 2
            window = np.zeros(len(text), bool)
            offset = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            window[at[offset < n[block]]] = True
            order = suffix_order(text, 258, length, memory)
            order = order[window[order]]
            raw = np.zeros(len(text) + 8, np.uint8)
            raw[at] = s
            alike = shares_prefix(raw, order[1:], order[:-1], length)
            group = np.concatenate([[0], np.cumsum(~alike)])
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            order, group = order[many], group[many]
            owner = np.zeros(len(text), np.int32)
            owner[at] = block
            own = owner[order]
            place = p[own] + order - begin[own]
            rank = np.lexsort((place, d[own], group))
            order, group, own, place = order[rank], group[rank], own[rank], place[rank]
            new = np.ones(len(order), bool)
            new[1:] = group[1:] != group[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
            later = (d[own] > d[own][head]) | same_row(d[own], place, group, shift)
            gone = np.sort(order[later])
            own = owner[gone]
            cut = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
            runs = np.diff(cut, append=len(gone)).astype(np.int32)
            g = gone[cut]
            run_d, run_p = d[owner[g]], p[owner[g]] + g - begin[owner[g]]
            batch = merged_groups([(run_d % buckets, {"done_d": run_d, "done_p": run_p, "done_n": runs})], DONE_SCHEMA)
            return pa.Table.from_batches([batch])

        return task

    return make


def kept_bytes(length: int, carry: Sequence[str], shift: int):
    def kept_part(docs: pa.Table, spans: Spans, at: int) -> pa.Table:
        buf, offsets = flat(docs.column("text"))
        gone = spans.covered(offsets, at, length)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        starts[inner] = gone[inner]
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        sizes = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept = pa.Array.from_buffers(
            pa.binary(), docs.num_rows, [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(buf[~gone].tobytes())]
        )
        columns = {
            "doc_id": docs.column("doc_id"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(count(gone), pa.int64()),
            "n_spans": pa.array(count(starts), pa.int64()),
            "kept": kept,
        } | {c: docs.column(c) for c in carry}
        return pa.table(columns)

    def task(docs: pa.Table, runs: pa.Table) -> pa.Table:
        spans, out, at = Spans(docs, runs, shift), [], 0
        for part in chunks(docs, "text", TEXT_BYTES):
            out.append(kept_part(part, spans, at))
            at += part.num_rows
        return pa.concat_tables(out) if out else kept_part(docs, spans, 0)

    return task


def suffix_dedup(
    docs: DataFrame, length: int = 100, gram: int = 32, memory: int = 64 << 20, carry: Sequence[str] = (), crowd: int = 100_000
) -> DataFrame:
    """Texts, as UTF-8 bytes, without every byte that a repeated ``length``-byte string covers.

    A string counts as repeated where it also starts earlier: in a document with a smaller ``doc_id``, or in the same
    one further left. Strings are judged on the input, overlaps count and none crosses documents. Returns one row per
    row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept`` (binary) and the columns
    named in ``carry``. ``memory`` bounds the bytes that each queue of the suffix sorter keeps off disk.

    Null text is empty. A null ``doc_id`` is smaller than every other id. Rows that share an id never remove bytes
    of each other, so equal rows get equal results. An empty table gives an empty result; other columns are ignored unless carried. Long
    texts are read whole. ``crowd``: see ``blocks.repeated_runs``.
    """
    carry = tuple(carry)
    split, runs, shift = repeated_runs(
        docs, byte_units, length, gram, True, bytes_of(length), BYTES_SCHEMA, compare_suffixes(length, memory),
        TEXT_BYTES, carry=carry, crowd=crowd,
    )
    types = dict(split.dtypes)
    extra = "".join(f", `{c}` {types[c]}" for c in carry)
    return (
        split.groupBy("bucket")
        .cogroup(runs.groupBy("bucket"))
        .applyInArrow(
            lean(kept_bytes(length, carry, shift)), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{extra}"
        )
    )


def digest_rows(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
