"""Substring dedup over word windows: a De Bruijn graph of word k-mers with compacted paths.

Every window of ``k`` words is an edge between its first and its last ``k - 1`` words. Consecutive edges that share an
anchor (``blocks``) form a path piece. Pieces with one anchor meet in a shuffle join on it. Where all copies of a piece
agree the path does not branch, and the piece stands for all its edges at once; where they differ the graph branches or
ends, and the piece's single edges are fetched by their source coordinates (document, word) through a join with the
documents and compared edge by edge. Settled pieces join their documents again, where neighbouring pieces run together
into the long repeated spans.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import Words, chunks, flat, gram_hashes, lean, unpacked
from gridpulse.llm.blocks import DONE_SCHEMA, KINDS, Spans, locate, merged_groups, repeated_runs

EDGE_SCHEMA = "bucket int, a binary, d binary, p binary, n binary, w binary"
TEXT_BYTES = 1 << 20


def word_units(batch) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*flat(batch.column("text")))
    return words.hashes(), words.first


def edges_of(k: int):
    """Single edges of the requested pieces, packed by anchor bucket."""

    def make(buckets: int, shift: int):
        def task(docs: pa.Table, asked: pa.Table) -> pa.Table:
            a, d, p, n = (unpacked(asked.column(f"ask_{x}"), KINDS[x]) for x in "adpn")
            empty = merged_groups([], EDGE_SCHEMA)
            if not len(d) or not docs.num_rows:
                return pa.Table.from_batches([empty])
            row, start = locate(docs, d, p, shift)
            order = np.argsort(row, kind="stable")
            a, d, p, n, row, start = a[order], d[order], p[order], n[order], row[order], start[order]
            out, at = [], 0
            for part in chunks(docs, "text", TEXT_BYTES):
                units, first = word_units(part)
                lo, hi = np.searchsorted(row, [at, at + part.num_rows])
                if hi > lo:
                    edges = gram_hashes(units, k)
                    begin = first[row[lo:hi] - at] + start[lo:hi]
                    count = n[lo:hi].astype(np.int64)
                    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    out.append(edges[np.repeat(begin, count) + offset])
                at += part.num_rows
            w = np.concatenate(out)
            bucket = (a % np.uint64(buckets)).astype(np.int64)
            count = n.astype(np.int64)
            batch = merged_groups(
                [(bucket, {"a": a, "d": d, "p": p, "n": n}), (np.repeat(bucket, count), {"w": w})], EDGE_SCHEMA
            )
            return pa.Table.from_batches([batch])

        return task

    return make


def compare_edges(buckets: int, shift: int):
    """Edges of one anchor bucket that also start in a document with a smaller id, as runs."""

    def task(table: pa.Table) -> pa.Table:
        a, d, p, n = (unpacked(table.column(x), KINDS[x]) for x in "adpn")
        w = unpacked(table.column("w"), np.uint64)
        count = n.astype(np.int64)
        piece = np.repeat(np.arange(len(a)), count)
        offset = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((d[piece], w, a[piece]))
        sa, sw, sd = a[piece][order], w[order], d[piece][order]
        new = np.ones(len(order), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sw[1:] != sw[:-1])
        gone = np.zeros(len(order), bool)
        gone[order] = sd > sd[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = np.flatnonzero(gone)
        cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(piece[at], prepend=-1) != 0))
        size = np.diff(cut, append=len(at)).astype(np.int32)
        s = at[cut]
        run_d, run_p = d[piece[s]], p[piece[s]] + offset[s]
        batch = merged_groups([(run_d % buckets, {"done_d": run_d, "done_p": run_p, "done_n": size})], DONE_SCHEMA)
        return pa.Table.from_batches([batch])

    return task


def kept_words(k: int, carry: Sequence[str], shift: int):
    """Texts of a bucket without the words of settled windows."""

    def kept_part(docs: pa.Table, spans: Spans, at: int) -> pa.Table:
        buf, offsets = flat(docs.column("text"))
        words = Words(buf, offsets)
        gone = spans.covered(words.first, at, k)
        spaced = buf.copy()
        keep = np.zeros(len(buf) + 1, np.int8)
        s, e = words.starts[~gone], words.ends[~gone]
        np.add.at(keep, s, 1)
        np.add.at(keep, e, -1)
        mask = np.cumsum(keep[:-1], dtype=np.int8) > 0
        text = np.repeat(np.arange(docs.num_rows), np.diff(words.first))[~gone]
        between = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, int)
        gap = e[between]
        spaced[gap] = 0x20
        mask[gap] = True
        sizes = np.concatenate([[0], np.cumsum(mask)])[offsets]
        data = spaced[mask].tobytes()
        kept = pa.StringArray.from_buffers(docs.num_rows, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(data))
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        columns = {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(np.diff(removed), pa.int64()),
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


def substring_dedup(docs: DataFrame, k: int = 13, gram: int = 4, carry: Sequence[str] = (), crowd: int = 100_000) -> DataFrame:
    """Documents without the words of repeated ``k``-word windows.

    A word goes when a window that covers it has a word sequence that also starts in a document with a smaller
    ``doc_id``; windows are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``. Returns one row per row of
    ``docs``: ``doc_id, n_words, n_removed, kept`` (words joined by one space) and the columns named in ``carry``.

    Null text counts as no words and gives ''. A null ``doc_id`` is smaller than every other id. Rows that share an id
    never remove words of each other; equal rows get equal results. An empty table gives an empty result. Other columns
    of ``docs`` are ignored unless carried. Long texts are read whole. ``crowd``: see ``blocks.repeated_runs``.
    """
    carry = tuple(carry)
    split, runs, shift = repeated_runs(
        docs, word_units, k, gram, False, edges_of(k), EDGE_SCHEMA, compare_edges, TEXT_BYTES, carry=carry, crowd=crowd
    )
    types = dict(split.dtypes)
    extra = "".join(f", `{c}` {types[c]}" for c in carry)
    return (
        split.groupBy("bucket")
        .cogroup(runs.groupBy("bucket"))
        .applyInArrow(lean(kept_words(k, carry, shift)), f"doc_id long, n_words long, n_removed long, kept string{extra}")
    )


def digest_rows(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
