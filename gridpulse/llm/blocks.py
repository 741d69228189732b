"""Repeated windows of a corpus, found through content-defined blocks.

Every window of ``window`` consecutive units has an anchor: its ``gram`` units with the least hash, leftmost on ties.
Equal windows have equal anchors, so rows that share no anchor never need to meet. Consecutive windows with one anchor
form a block. Blocks are first compared whole: a block whose content starts earlier elsewhere is settled at once. Only
where blocks of one anchor differ are their single windows asked for and compared.

Columns travel packed (raw numpy bytes, a row for each task and bucket), which keeps tens of millions of small records
out of the row format. A block that many documents share leaves each task at most once. A gram that very many documents
have in unlike surroundings would gather a block of each in one bucket; such grams are counted first, and a window takes
one as its anchor only if it holds no other gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.arrays import chunks, flat, ids_of, inside, lean, mix, packed, unpacked
from gridpulse.llm.spark import buckets_for, id_bucket, pinned, stored

SEGMENT = 1 << 18
SLICES = 16
PLACE = np.uint64(20)
_ODD = np.uint64(0x9E3779B97F4A7C15)

BLOCK_SCHEMA = "bucket int, a binary, c binary, d binary, p binary, n binary, done_d binary, done_p binary, done_n binary"
BACK_SCHEMA = "bucket int, done_d binary, done_p binary, done_n binary, ask_a binary, ask_d binary, ask_p binary, ask_n binary"
DONE_SCHEMA = "bucket int, done_d binary, done_p binary, done_n binary"
KINDS = {"a": np.uint64, "c": np.uint64, "d": np.int64, "p": np.int64, "n": np.int32}


def kind_of(name: str):
    return KINDS[name[-1]]


class Cutter:
    """Cuts unit sequences into blocks of windows with one anchor."""

    def __init__(self, window: int, gram: int, common: np.ndarray | None = None):
        self.window, self.gram = window, gram
        self.size = SEGMENT + window + 1
        self.common = np.zeros(0, np.uint64) if common is None else common
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.common & np.uint64(0xFFFF)] = True
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size, _ODD)]), dtype=np.uint64)

    def grams(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams of a segment, and the sums that they and longer stretches are hashed from."""
        prefix = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.power[: len(units)], out=prefix[1:])
        k = len(units) - self.gram + 1
        return mix((prefix[self.gram :] - prefix[:k]) * self.power[self.size - np.arange(k)]), prefix

    def is_common(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        at = np.flatnonzero(self.maybe[grams & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.common, grams[at]), len(self.common) - 1)
        out[at] = self.common[place] == grams[at]
        return out

    def __call__(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor, content, text number, start in its text and number of windows of each block."""
        window, gram, power, size = self.window, self.gram, self.power, self.size
        windows = len(units) - window + 1
        if windows <= 0:
            return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int32))
        fits = inside(first, window, windows)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        low = np.uint64((1 << int(PLACE)) - 1)
        width = window - gram + 1
        found = []
        for a in range(0, windows, SEGMENT):
            b = min(a + SEGMENT, windows)
            u = units[a : b + window - 1]
            grams, prefix = self.grams(u)
            k = len(grams)
            least = (grams >> np.uint64(1) & ~low) | np.arange(k, dtype=np.uint64)
            if len(self.common):  # after all others
                least |= self.is_common(grams).astype(np.uint64) << np.uint64(63)
            span = 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: b - a], least[width - span : width - span + b - a])
            at = (least[: b - a] & low).astype(np.int64)
            v = np.flatnonzero(fits[a:b])
            if not len(v):
                continue
            cut = np.flatnonzero((np.diff(v, prepend=-2) != 1) | (np.diff(at[v], prepend=-1) != 0))
            s = v[cut]
            n = np.diff(cut, append=len(v))
            e = s + n - 1 + window
            content = mix((prefix[e] - prefix[s]) * power[size - s] ^ n.astype(np.uint64))
            doc = text[a + s]
            found.append((grams[at[s]], content, doc, a + s - first[doc], n.astype(np.int32)))
        if not found:
            return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int32))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def same_row(d: np.ndarray, p: np.ndarray, group: np.ndarray, shift: int) -> np.ndarray:
    """Entries, ordered by group, document and place, whose predecessor has their group and row."""
    out = np.zeros(len(d), bool)
    out[1:] = (group[1:] == group[:-1]) & (d[1:] == d[:-1]) & (p[1:] >> shift == p[:-1] >> shift)
    return out


def settle(a, c, d, p, within: bool, shift: int):
    """Order by (anchor, content, document, place); which rows start a content; which have an earlier equal.

    Earlier is a smaller document and, ``within`` one row, a place further left. A place is the row's number among those
    that share their id, shifted left by ``shift`` bits, and the start in the text; rows of one id don't settle each other.
    """
    order = np.lexsort((p, d, c, a))
    a, c, d, p = a[order], c[order], d[order], p[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    gone = (d > d[head][number]) | (within & same_row(d, p, number, shift))
    return order, new, gone


def rows(schema_names: list[str], groups: np.ndarray, columns: dict[str, list[bytes]]) -> pa.RecordBatch:
    arrays = [pa.array(groups.astype(np.int32), pa.int32())]
    arrays += [pa.array(columns.get(n, [b""] * len(groups)), pa.binary()) for n in schema_names[1:]]
    return pa.RecordBatch.from_arrays(arrays, names=schema_names)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def merged_groups(parts: list[tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> pa.RecordBatch:
    """Packs several column sets, each with its own bucket numbers, into rows of one schema."""
    out: dict[int, dict[str, bytes]] = {}
    for groups, columns in parts:
        if len(groups):
            keys, values = packed(groups, columns)
            for i, k in enumerate(keys):
                out.setdefault(int(k), {}).update({n: values[n][i] for n in values})
    keys = np.array(sorted(out), np.int64)
    cols = {n: [out[int(k)].get(n, b"") for k in keys] for n in names(schema)[1:]}
    return rows(names(schema), keys, cols)


def block_rows(units_of: Callable, window: int, gram: int, buckets: int, within: bool, each: int, flush: int, shift: int, common: Broadcast | None = None):
    """Map task: packed blocks of whole texts by anchor bucket, equal ones of the task already settled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window, gram, common.value if common else None)
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            a, c, d, p, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, _, gone = settle(a, c, d, p, within, shift)
            keep, drop = order[~gone], order[gone]
            bucket = (a % np.uint64(buckets)).astype(np.int64)
            return merged_groups(
                [
                    (bucket[keep], {"a": a[keep], "c": c[keep], "d": d[keep], "p": p[keep], "n": n[keep]}),
                    (bucket[drop], {"done_d": d[drop], "done_p": p[drop], "done_n": n[drop]}),
                ],
                BLOCK_SCHEMA,
            )

        count = 0
        for batch in batches:
            for part in chunks(batch, "text", each):
                units, first = units_of(part)
                a, c, doc, start, n = cutter(units, first)
                if len(a):
                    ids, own = ids_of(part.column("doc_id")), part.column("own").to_numpy(zero_copy_only=False)
                    held.append((a, c, ids[doc], (own[doc] << shift) + start, n))
                    count += len(a)
                if count >= flush:
                    count = 0
                    yield out()
        if held:
            yield out()

    return task


def tally(held: list[tuple[np.ndarray, np.ndarray]], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds the values and counts of ``parts`` to ``held``: sorted values and counts, in slices of the range of 64 bits.

    Only ``parts`` are sorted and one slice is copied at a time, so this takes little memory besides the slices.
    """
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))[: len(values)]
    values, counts = values[cut], np.add.reduceat(counts, cut) if len(cut) else counts
    edges = np.arange(1, len(held), dtype=np.uint64) * np.uint64(2**64 // len(held))
    ends = [0, *np.searchsorted(values, edges), len(values)]
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        (old, number), new, n = held[i], values[lo:hi], counts[lo:hi]
        at = np.searchsorted(old, new)
        known = np.zeros(len(new), bool)
        within = at < len(old)
        known[within] = old[at[within]] == new[within]
        number[at[known]] += n[known]
        held[i] = np.insert(old, at[~known], new[~known]), np.insert(number, at[~known], n[~known])


def gram_counts(units_of: Callable, window: int, gram: int, each: int, least: int, most: int = 4_000_000, step: int = 1 << 19):
    """Map task: grams that this task holds ``least`` times or more.

    A task holds up to ``most`` grams, and ``step`` and a segment's that wait to be added.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window, gram)
        # a gram of a high hash is hardly ever the least one of a window
        limit = np.uint64(min(2**64 - 1, 10 * 2**64 // (window - gram + 1)))
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, waiting, count = [none] * SLICES, [none], 0

        def rows():
            grams = np.concatenate([g[n >= least] for g, n in held])
            return pa.RecordBatch.from_pydict({"gram": grams.view(np.int64), "n": np.concatenate([n[n >= least] for _, n in held])})

        for batch in batches:
            for part in chunks(batch, "text", each):
                units, first = units_of(part)
                for a in range(0, len(units) - gram + 1, SEGMENT):
                    end = min(a + SEGMENT + gram - 1, len(units))
                    grams, _ = cutter.grams(units[a:end])
                    fits = inside(first, gram, len(units))[a : a + len(grams)]
                    waiting.append(np.unique(grams[fits & (grams <= limit)], return_counts=True))
                    count += len(waiting[-1][0])
                    if count >= step:
                        tally(held, waiting)
                        waiting, count = [none], 0
                        if sum(len(g) for g, _ in held) > most:  # what is rare in so much text is rare
                            yield rows()
                            held = [none] * SLICES
        tally(held, waiting)
        yield rows()

    return task


def common_grams(plain: DataFrame, units_of: Callable, window: int, gram: int, each: int, crowd: int, least: int = 8) -> np.ndarray:
    """Sorted hashes of the grams that all texts together hold over ``crowd`` times; at most one gram in ``crowd`` does.

    Tasks leave out grams that they hold fewer than ``least`` times.
    """
    counted = plain.select("text").mapInArrow(lean(gram_counts(units_of, window, gram, each, least)), "gram long, n long")
    found = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > crowd).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def compare_blocks(buckets: int, within: bool, shift: int):
    """Reduce task of one anchor bucket: settled blocks, and requests for the windows of blocks that differ."""

    def task(table: pa.Table) -> pa.Table:
        a, c, d, p, n = (unpacked(table.column(x), KINDS[x]) for x in "acdpn")
        order, new, gone = settle(a, c, d, p, within, shift)
        a, d, p, n = a[order], d[order], p[order], n[order]
        anchor = np.ones(len(a), bool)
        anchor[1:] = a[1:] != a[:-1]
        number = np.cumsum(anchor) - 1
        contents = np.bincount(number[new], minlength=number[-1] + 1 if len(number) else 0)
        ask = ~gone & (contents[number] > 1)
        done = {x: unpacked(table.column(f"done_{x}"), KINDS[x]) for x in "dpn"}
        done = {x: np.concatenate([done[x], y[gone]]) for x, y in (("d", d), ("p", p), ("n", n))}
        batch = merged_groups(
            [
                (done["d"] % buckets, {f"done_{x}": done[x] for x in "dpn"}),
                (d[ask] % buckets, {"ask_a": a[ask], "ask_d": d[ask], "ask_p": p[ask], "ask_n": n[ask]}),
            ],
            BACK_SCHEMA,
        )
        return pa.Table.from_batches([batch])

    return task


def locate(table: pa.Table, d: np.ndarray, p: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of the table that each (document, place) means, and the start inside its text."""
    ids, own = ids_of(table.column("doc_id")), table.column("own").to_numpy()
    start = p & ((1 << shift) - 1)
    known, number = np.unique(ids, return_inverse=True)
    held, rank = np.unique(own, return_inverse=True)
    key = number * len(held) + rank
    order = np.argsort(key, kind="stable")
    wanted = np.searchsorted(known, d) * len(held) + np.searchsorted(held, p >> shift)
    return order[np.searchsorted(key[order], wanted)], start


class Spans:
    """Settled windows of a bucket's texts, by row."""

    def __init__(self, table: pa.Table, done: pa.Table, shift: int):
        d, p, n = (unpacked(done.column(f"done_{x}"), KINDS[x]) for x in "dpn")
        row = start = np.zeros(0, np.int64)
        if len(d):
            row, start = locate(table, d, p, shift)
        order = np.argsort(row, kind="stable")
        self.row, self.start, self.count = row[order], start[order], n[order]

    def covered(self, first: np.ndarray, at: int, window: int) -> np.ndarray:
        """Which units of the texts from row ``at`` on (cut by ``first``) lie in a settled window."""
        lo, hi = np.searchsorted(self.row, [at, at + len(first) - 1])
        change = np.zeros(int(first[-1]) + 1, np.int32)
        begin = first[self.row[lo:hi] - at] + self.start[lo:hi]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + self.count[lo:hi] + window - 1, -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


def repeated_runs(
    docs: DataFrame,
    units_of: Callable,
    window: int,
    gram: int,
    within: bool,
    detail: Callable[[int, int], Callable],
    detail_schema: str,
    resolve: Callable[[int, int], Callable],
    each: int,
    carry: tuple[str, ...] = (),
    crowd: int = 100_000,
) -> tuple[DataFrame, DataFrame, int]:
    """Typed documents with their bucket, packed runs of windows that start earlier elsewhere, and the bits of a start.

    ``detail(buckets, shift)`` turns (documents of a bucket, requests) into packed rows by anchor bucket and
    ``resolve(buckets, shift)`` turns those of one anchor bucket into settled runs. Grams that stand in the corpus over
    ``crowd`` times are no anchors where a window has another.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    plain, total, shift = with_row_numbers(plain)
    buckets = buckets_for(total)
    common = plain.sparkSession.sparkContext.broadcast(common_grams(plain, units_of, window, gram, each, crowd))
    found = plain.select("doc_id", "own", "text").mapInArrow(
        lean(block_rows(units_of, window, gram, buckets, within, each, flush=250_000, shift=shift, common=common)), BLOCK_SCHEMA
    )
    back = pinned(found.groupBy("bucket").applyInArrow(lean(compare_blocks(buckets, within, shift)), BACK_SCHEMA))
    split = plain.withColumn("bucket", id_bucket(F.col("doc_id"), buckets))
    asked = back.select("bucket", "ask_a", "ask_d", "ask_p", "ask_n").where(F.length("ask_d") > 0)
    details = (
        split.select("bucket", "doc_id", "own", "text")
        .groupBy("bucket")
        .cogroup(asked.groupBy("bucket"))
        .applyInArrow(lean(detail(buckets, shift)), detail_schema)
    )
    settled = details.groupBy("bucket").applyInArrow(lean(resolve(buckets, shift)), DONE_SCHEMA)
    runs = back.select(*names(DONE_SCHEMA)).where(F.length("done_d") > 0).unionByName(settled)
    return split, runs, shift


def with_row_numbers(plain: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents with ``own`` (which row of its id a row is), the bytes of all texts, and the bits that a start may take.

    Where every id is there once, ``own`` is 0 and nothing is written. Else the documents are stored with a number of
    their own for every row, so that all later passes mean the same row by it.
    """
    size = F.octet_length("text").cast("long")
    total, longest = plain.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    shift = int(longest).bit_length() + 1
    if not plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").take(1):
        return plain.withColumn("own", F.lit(0).cast("long")), total, shift
    held = stored(plain.withColumn("_at", F.monotonically_increasing_id()))
    # numbers without gaps: rows before each partition, of which there are few, and the place in it
    counts = held.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = held.count()
    if rows.bit_length() + shift > 62:
        raise ValueError("too many rows for texts of this length")
    own = F.col("_first") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    numbered = held.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(counts), "_part")
    return numbered.withColumn("own", own).drop("_at", "_part", "_first"), total, shift
