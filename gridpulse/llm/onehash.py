"""Near-duplicate components by one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash deals a set's shingles into bins and keeps the least of each; an empty bin takes the value of the first filled bin
in an order of its own, the same for all sets. Sets that agree in a band of bins share a bucket. A bucket is not compared
pair by pair: every set gets one edge to the most central hub of its buckets first, which already connects most copies. Only
buckets that still hold several components go on: those of their sets that are not of the bucket's largest component are
free, and some free sets are hubs that every other set of the bucket is compared with, more of them in every turn until all
free sets were hubs. Signatures and odd sketches rule pairs out, and a link is confirmed on the whole shingle sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.arrays import NULL_ID, chunks, flat, lean, mix
from gridpulse.llm.components import components
from gridpulse.llm.jaccard import shingle_sets, with_row_key
from gridpulse.llm.spark import pinned, salted_join, stored, texts_of

ROWS, BANDS = 5, 40
BINS = ROWS * BANDS
# a mark is a byte per bin, then the odd sketch: one parity per cell that the whole set's shingles are dealt into
CELLS = 1_600
MARK = BINS + CELLS // 8
SKETCH = "key long, t1 long, t2 long, h1 long, h2 long, n long, sig binary, bands array<long>"


def lowered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with A-Z lower-cased, and the offsets of each."""
    buf, offsets = flat(part.column("text"))
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8), offsets


def parts_of(batches, most: int = 1 << 20):
    for batch in batches:
        for part in chunks(batch, "text", most):
            for a in range(0, part.num_rows, 16_384):
                yield part.slice(a, 16_384)


@functools.cache
def probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``order[a, i]``: the bin that bin ``i`` looks at in its ``a``-th attempt; ``rank[j, i]``: the attempt at bin ``j``.

    A bin looks at itself first.
    """
    drawn = mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins)
    np.fill_diagonal(drawn, 0)
    order = np.argsort(drawn, axis=0, kind="stable").astype(np.int64)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(bins)[:, None], order.shape), axis=0)
    return order, rank


def one_permutation(ids: np.ndarray, first: np.ndarray, bins: int = BINS, few: int = 16) -> np.ndarray:
    """Least hash of each bin of each set, empty bins filled from others; sets must not be empty."""
    n = len(first) - 1
    h = mix(ids + np.uint64(0x51ED270B9F1C4A37))
    place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    cell = np.repeat(np.arange(n), np.diff(first)) * bins + place.astype(np.int64)
    out, filled = np.full(n * bins, 0xFFFFFFFF, np.uint32), np.zeros(n * bins, bool)
    np.minimum.at(out, cell, h.astype(np.uint32))
    filled[cell] = True
    out, filled = out.reshape(n, bins), filled.reshape(n, bins)
    count = filled.sum(axis=1)
    order, rank = probes(bins)
    # of a few filled bins, the one of least rank is looked up at once
    for size in np.unique(count[count <= few]).tolist():
        rows = np.flatnonzero(count == size)
        held = np.nonzero(filled[rows])[1].reshape(len(rows), size)
        for a in range(0, len(rows), 512):
            part = held[a : a + 512]
            pick = np.take_along_axis(part, rank[part].argmin(axis=1), axis=1)
            out[rows[a : a + 512]] = np.take_along_axis(out[rows[a : a + 512]], pick, axis=1)
    row, column = np.nonzero(~filled & (count > few)[:, None])
    attempt = 0
    while len(row):
        source = order[attempt, column]
        ok = filled[row, source]
        out[row[ok], column[ok]] = out[row[ok], source[ok]]
        row, column = row[~ok], column[~ok]
        attempt += 1
    return out


def odd_sketch(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``CELLS`` cells, as bits; two sets' sketches differ where their difference is odd."""
    n = len(first) - 1
    cell = ((mix(ids + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(CELLS) >> np.uint64(32)).astype(np.int64)
    cell += np.repeat(np.arange(n), np.diff(first)) * CELLS
    out = np.zeros(n * CELLS // 8, np.uint8)
    np.bitwise_xor.at(out, cell >> 3, np.left_shift(1, cell & 7).astype(np.uint8))
    return out.reshape(n, CELLS // 8)


def sketch_task(size: int):
    """Hash, size, signature and band keys of every set; empty sets have neither signature nor bands."""

    def task(batches):
        for part in parts_of(batches):
            ids, first = shingle_sets(*lowered(part), size)
            n = np.diff(first)
            sums = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids + np.uint64(salt << 50)), dtype=np.uint64)])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            some = np.flatnonzero(n)
            least = one_permutation(ids, np.append(first[some], len(ids)))
            band = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(some), BANDS)).copy()
            for r in range(ROWS):
                band = mix(band ^ least[:, r::ROWS].astype(np.uint64))
            marks = (mix(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            marks = np.hstack([marks, odd_sketch(ids, np.append(first[some], len(ids)))])
            ends = np.concatenate([[0], np.cumsum(n > 0)])
            sig = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((ends * MARK).astype(np.int32)), pa.py_buffer(marks.tobytes())]
            )
            bands = pa.ListArray.from_arrays((ends * BANDS).astype(np.int32), band.view(np.int64).ravel())
            yield pa.RecordBatch.from_pydict(
                {
                    "key": part.column("key"), "t1": part.column("t1"), "t2": part.column("t2"),
                    "h1": sums[0], "h2": sums[1], "n": n.astype(np.int64), "sig": sig, "bands": bands,
                }
            )

    return task


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    buf, _ = flat(column)
    return buf.reshape(-1, width)


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Places of the pairs of marks ``x, y`` of sets of ``n`` and ``m`` shingles that may be links.

    A link's sets differ in at most ``(100 - percent) / (100 + percent)`` of their shingles together, and their odd sketches
    differ in no more cells than that, nor in five standard errors more than so many shingles fill oddly. Signatures must
    agree as often as a link lets expect, but for five standard errors; a small set has as many independent values as
    shingles.
    """
    threshold, large = percent / 100, np.maximum(n, m)
    at = np.flatnonzero(100 * np.minimum(n, m) >= percent * large)
    differ = (100 - percent) / (100 + percent) * (n[at] + m[at]) + 1e-9
    filled = CELLS / 2 * (1 - (1 - 2 / CELLS) ** differ)
    most = np.minimum(differ, filled + 5 * np.sqrt(filled * (1 - filled / CELLS)))
    wide = lambda marks: np.ascontiguousarray(marks[:, BINS:]).view(np.uint64)
    odd = np.bitwise_count(wide(x)[at] ^ wide(y)[at]).sum(axis=1, dtype=np.int64)
    at = at[odd <= most]
    agree = (x[at, :BINS] == y[at, :BINS]).mean(axis=1)
    return at[agree >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.minimum(BINS, large[at]))]


def plausible_task(percent: int):
    def task(batches):
        for batch in batches:
            marks = (rows_of(batch.column(c), MARK) for c in ("su", "sv"))
            sizes = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            yield batch.select(["u", "v"]).take(pa.array(may_link(*marks, *sizes, percent)))

    return task


def hub_task(percent: int):
    """Plausible pairs of the sets of a row with the hubs of their bucket that are of another component."""

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sets, hubs = (batch.column(c).slice(i, 1).flatten() for c in ("sets", "hubs"))
                (node, part, n), (hub, whole, m) = ([x.field(c).to_numpy() for c in ("node", "part", "n")] for x in (sets, hubs))
                # two hubs meet twice, once as a set of the other's list
                twice = sets.field("hub").to_numpy(zero_copy_only=False)[:, None] & (node[:, None] < hub)
                row, column = np.nonzero((part[:, None] != whole) & ~twice)
                x, y = rows_of(sets.field("sig"), MARK), rows_of(hubs.field("sig"), MARK)
                for a in range(0, len(row), 1 << 14):
                    u, v = row[a : a + (1 << 14)], column[a : a + (1 << 14)]
                    at = may_link(x[u], y[v], n[u], m[v], percent)
                    yield pa.RecordBatch.from_pydict({"u": pa.array(node[u[at]], pa.int64()), "v": pa.array(hub[v[at]], pa.int64())})

    return task


def set_task(size: int):
    """Shingle ids of each text, six bytes each."""

    def task(batches):
        for part in parts_of(batches):
            ids, first = shingle_sets(*lowered(part), size)
            data = np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            packed = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 6).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("key", "t1", "t2")} | {"ids": packed})

    return task


def unpacked_ids(value: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def linked_task(percent: int):
    """Edges whose whole sets are as alike as asked."""

    def task(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("iu"), batch.column("iv"), strict=True)):
                a, b = unpacked_ids(x), unpacked_ids(y)
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return task


def confirmed(alike: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among plausible pairs ``u, v``; ``v`` is the hub, which may stand in any number of pairs."""
    pairs = alike.join(sets.select(F.col("node").alias("u"), F.col("ids").alias("iu")), "u")
    whole = salted_join(pairs, sets.select(F.col("node").alias("v"), F.col("ids").alias("iv")), ["v"], counted=alike)
    return whole.select("u", "v", "iu", "iv").mapInArrow(lean(linked_task(percent)), "u long, v long")


def first_links(members: DataFrame, weights: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of every set to one hub: of its buckets' hubs, the one that most of them have, which is the most alike.

    A bucket's hub is its set that shares most places.
    """
    hubs = members.join(weights, "node").groupBy("bucket").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("hub"))).alias("h"), F.max("rows").alias("many")
    )
    spokes = salted_join(members.select("bucket", "node"), stored(hubs), ["bucket"], rows="many")
    shared = spokes.where(F.col("node") != -F.col("h.hub")).groupBy("node", "h").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("node").agg((-F.max(F.struct("shared", "h"))["h"]["hub"]).alias("v"))
    edges = stored(best.select(F.col("node").alias("u"), "v"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = salted_join(edges.join(side("u"), "u"), side("v"), ["v"], counted=edges)
    alike = both.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(lean(plausible_task(percent)), "u long, v long")
    return confirmed(stored(alike), sets, percent)


def open_buckets(members: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component ``part``, and the buckets of several components: largest one, sets and free sets."""
    named = members.join(linked, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    sizes = named.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("sets"))
    tops = tops.select("bucket", F.col("top.part").alias("largest"), "sets", (F.col("sets") - F.col("top.n")).alias("free_sets"))
    return named, stored(tops.where("free_sets > 0"))


def linked_sets(nodes: DataFrame, texts: DataFrame, size: int, percent: int, few: int, share: int = 200) -> DataFrame:
    """``node, component`` by links that connect whatever sets of a bucket the links of all sets connect.

    A turn compares some free sets of each open bucket, its hubs, with all its sets: ``few`` central ones first, then eight
    times as many by hash in every turn. Hubs are taken out then, and a bucket whose free sets were all hubs is done. So
    every two sets of a bucket that no links connect are compared, in blocks of bounded size, after a number of turns that
    grows with the logarithm of the largest bucket.
    """
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = stored(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    members = stored(salted_join(bands, crowded, ["bucket"], rows="rows").select("bucket", "node", "rows"))
    weights = stored(members.groupBy("node").agg(F.sum("rows").alias("weight")))
    # the sets of all that share a bucket, read from the texts once
    places = weights.join(nodes.select("node", "key", "t1", "t2"), "node").select("node", "key", "t1", "t2")
    sets = texts.select("key", "t1", "t2", "text").mapInArrow(lean(set_task(size)), "key long, t1 long, t2 long, ids binary")
    sets = stored(sets.join(places, ["key", "t1", "t2"]).dropDuplicates(["key", "t1", "t2"]).select("node", "ids"))
    links = stored(first_links(members, weights, nodes, sets, percent))
    members, most = members.select("bucket", "node"), few
    marks = nodes.select("node", "n", "sig")
    linked = stored(components(links))
    while True:
        named, tops = open_buckets(members, linked)
        if not tops.take(1):
            return linked
        held = salted_join(named, tops, ["bucket"], rows="sets")
        if most == few:
            held = stored(held.withColumn("hub", F.lit(False)))
            order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "node")
            hubs = held.where("part <> largest").join(weights, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= few)
            hubs = hubs.withColumn("list", F.lit(0).cast("long"))
        else:
            chosen = F.pmod(F.xxhash64("node", F.lit(most)), F.col("free_sets")) < most
            held = stored(held.withColumn("hub", (F.col("part") != F.col("largest")) & chosen))
            hubs = held.where("hub").withColumn("list", F.pmod(F.xxhash64("node"), F.ceil(F.least("free_sets", F.lit(most)) / share)))
        hubs = stored(hubs.select("bucket", "list", "node", "part").join(marks, "node"))
        lists = hubs.groupBy("bucket", "list").agg(F.collect_list(F.struct("node", "part", "n", "sig")).alias("hubs"))
        # sets go in shares of about ``share``, so that a list of hubs is sent once a share
        dealt = held.withColumn("share", F.pmod(F.xxhash64("node"), F.ceil(F.col("sets") / share)))
        shares = dealt.join(marks, "node").groupBy("bucket", "share").agg(F.collect_list(F.struct("node", "part", "n", "sig", "hub")).alias("sets"))
        counted = dealt.select("bucket", "share").distinct()
        if most > few:
            each = stored(hubs.select("bucket", "list").distinct())
            shares, counted = shares.join(each, "bucket"), counted.join(each, "bucket")
            met = salted_join(shares, lists, ["bucket", "list"], counted=counted, crowd=500)
        else:
            met = salted_join(shares, lists.drop("list"), ["bucket"], counted=counted, crowd=500)
        alike = met.select("sets", "hubs").mapInArrow(lean(hub_task(percent)), "u long, v long")
        new = stored(confirmed(stored(alike.distinct()), sets, percent))
        if new.take(1):
            links = stored(links.unionByName(new))
            linked = stored(components(links))
        rest = held.where(F.col("free_sets") > most).select("bucket", "node")
        if not rest.take(1):
            return linked
        members = stored(rest.join(hubs.select("bucket", "node"), ["bucket", "node"], "left_anti"))
        most *= 8


def near_duplicate_components(docs: DataFrame, percent: int = 80, size: int = 2, few: int = 128) -> DataFrame:
    """Components of texts whose sets of ``size``-word shingles share ``percent`` of their union or more.

    One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links reach, itself
    included) and ``kept`` (the two ids are equal). Equal sets are one; 40 bands of 5 bins miss a bucket of a pair at
    80 % with a chance of about 1e-7, and more rarely above. Whatever the number of sets of a bucket, every two of them that
    no links connect are compared; ``few`` is the number of hubs of the first turn.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer than ``size`` words has one shingle of all
    its words. Null, empty and blank texts have no shingle and are linked with nothing. Texts are read whole, whatever
    their length. A null id counts as the smallest and is returned as null; rows that share an id are judged each by its
    own text, and repeated rows have the same result. Other columns are ignored. An empty table gives an empty result.
    """
    texts = with_row_key(texts_of(docs))
    sketches = pinned(texts.select("key", "t1", "t2", "text").mapInArrow(lean(sketch_task(size)), SKETCH).withColumn("row", F.monotonically_increasing_id()))
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("key", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = stored(classes.select("h1", "h2", F.col("first.key").alias("least_id"), F.col("first.row").alias("node"), "rows"))
    nodes = sketches.join(classes.select("node"), F.col("row") == F.col("node")).select("node", "n", "sig", "bands", "key", "t1", "t2")
    nodes = stored(nodes)
    linked = linked_sets(nodes, texts, size, percent, few)
    found = stored(classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    heads = found.groupBy("component").agg(F.min("least_id").alias("head"))
    found = salted_join(found, heads, ["component"]).select("h1", "h2", "head", "rows")
    own = sketches.select("key", "h1", "h2", "n")
    filled = salted_join(own.where("n > 0"), found, ["h1", "h2"], rows="rows").select("key", "n", "head")
    whole = filled.unionByName(own.where("n = 0").select("key", "n", F.col("key").alias("head")))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return whole.select(
        back("key").alias("doc_id"), F.col("n").alias("n_shingles"), back("head").alias("component_id"), (F.col("key") == F.col("head")).alias("kept")
    )

