"""Similarity join of word-shingle sets by chosen paths.

Sets are embedded as min-hash tokens. A run walks from a root that samples one token position; sets that agree there go
down together, and a node with too many sets samples the next position. Small nodes are compared by brute force, all
pairs in blocks where a node stays large, and runs repeat until a pair at the threshold is missed less often than asked.
A pair is compared only in the first run that brings it together, so links are counted once without listing them.
Comparisons are of whole shingle sets; min-hashes only rule out pairs far from the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import NULL_ID, Words, chunks, flat, gram_hashes, inside, lean, mix
from gridpulse.llm.components import components
from gridpulse.llm.spark import pinned, prime_at_least, texts_of

TOKENS = 64
SKETCH_SCHEMA = "key long, t1 long, t2 long, h1 long, h2 long, n int, sig binary, k1 binary, k2 binary"
MEMBER = "leaf long, bi int, bj int, side int, run int, rep long, leaves array<long>"
_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle ids of each text, ascending, and where each text's begin (at most 65,536 texts).

    A text of fewer than ``size`` words has one shingle of all its words; a text without words has none.
    """
    words = Words(buf, offsets)
    h = words.hashes()
    count = np.diff(words.first)
    grams = gram_hashes(h, size)
    fits = inside(words.first, size, len(grams))
    text = words.text(0)
    ids, owner = grams[fits], text[: len(grams)][fits]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = []
        for i in short.tolist():
            part = h[words.first[i] : words.first[i + 1]]
            whole.append(gram_hashes(part, len(part))[0] ^ np.uint64(len(part)))
        ids, owner = np.concatenate([ids, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(48)) | (ids >> np.uint64(16)))
    owner = (keyed >> np.uint64(48)).astype(np.int64)
    return keyed & np.uint64((1 << 48) - 1), np.searchsorted(owner, np.arange(len(offsets)))


def parts_of(batches):
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            for a in range(0, part.num_rows, 65_536):
                yield part.slice(a, 65_536)


def sketch_task(size: int, runs: int):
    def task(batches):
        for part in parts_of(batches):
            ids, first = shingle_sets(*flat(part.column("text")), size)
            n = np.diff(first)
            filled = np.flatnonzero(n)
            mixed = mix(ids)
            sums = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids + np.uint64(salt << 50)), dtype=np.uint64)])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            sig = np.zeros((len(n), TOKENS), np.uint32)
            if len(filled):
                for k in range(TOKENS):
                    least = np.minimum.reduceat(mixed * _SEEDS[k], first[filled])
                    sig[filled, k] = (mix(least) >> np.uint64(32)).astype(np.uint32)
            k1, k2 = path_keys(sig, runs)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": part.column("key"),
                    "t1": part.column("t1"),
                    "t2": part.column("t2"),
                    "h1": pa.array(sums[0]),
                    "h2": pa.array(sums[1]),
                    "n": pa.array(n, pa.int32()),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    "k1": pa.array(k1.tolist(), pa.list_(pa.int64())),
                    "k2": pa.array(k2.tolist(), pa.list_(pa.int64())),
                }
            )

    return task


def path_keys(sig: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Node that each set reaches after one and after two sampled positions, for every run."""
    row = np.arange(len(sig))
    k1, k2 = np.zeros((len(sig), runs), np.int64), np.zeros((len(sig), runs), np.int64)
    for r in range(runs):
        root = mix(np.array([r + 1], np.uint64))[0]
        node = mix(sig[:, int(root % np.uint64(TOKENS))].astype(np.uint64) ^ root)
        place = (mix(node + np.uint64(1)) % np.uint64(TOKENS)).astype(np.int64)
        below = mix(node ^ mix(sig[row, place].astype(np.uint64) + np.uint64(2)))
        k1[:, r], k2[:, r] = node.view(np.int64), below.view(np.int64)
    return k1, k2


def runs_for(threshold: float, depth: int, missed: float) -> int:
    """Runs after which a pair at the threshold is missed with probability ``missed`` at most."""
    return math.ceil(math.log(missed) / math.log(1 - threshold**depth))


class Group:
    """Rows of one task, sorted so that each node's block pair is contiguous, and the pairs that it owns."""

    def __init__(self, table: pa.Table):
        get = lambda c: table.column(c).to_numpy()
        self.leaf, self.bi, self.bj = get("leaf"), get("bi"), get("bj")
        self.side, self.run, self.rep = get("side"), get("run"), get("rep")
        self.order = np.lexsort((self.rep, self.bj, self.bi, self.leaf))
        for name in ("leaf", "bi", "bj", "side", "run", "rep"):
            setattr(self, name, getattr(self, name)[self.order])
        lists = table.column("leaves").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        n = len(self.leaf)
        self.leaves = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[self.order] if n else np.zeros((0, 1), np.int64)
        same = (self.leaf[1:] == self.leaf[:-1]) & (self.bi[1:] == self.bi[:-1]) & (self.bj[1:] == self.bj[:-1])
        self.number = np.concatenate([[0], np.cumsum(~same)]) if n else np.zeros(0, int)
        self.begin = np.flatnonzero(np.diff(self.number, prepend=-1))

    def owned(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of different blocks, or of one block paired with itself, that no earlier run brings together."""
        ok = (self.bi[i] == self.bj[i]) | (self.side[i] != self.side[j])
        meet = self.leaves[i] == self.leaves[j]
        return ok & (meet.argmax(axis=1) == self.run[i])

    def pairs(self, most: int = 200_000):
        """All pairs of rows of one node and block pair, a bounded number at a time."""
        held, size = [], 0
        for step in range(1, len(self.leaf)):
            i = np.flatnonzero(self.number[step:] == self.number[:-step])
            if not len(i):
                break
            held.append((i, i + step))
            size += len(i)
            if size > most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def near_task(threshold: float):
    """Rows that own a pair whose min-hashes do not rule it out (five standard errors below the threshold)."""
    least = TOKENS * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / TOKENS))

    def task(table: pa.Table) -> pa.Table:
        g = Group(table)
        buf, _ = flat(table.column("sig"))
        sig = np.frombuffer(buf.tobytes(), np.uint32).reshape(len(g.leaf), -1)[g.order] if len(g.leaf) else np.zeros((0, TOKENS))
        live = np.zeros(len(g.leaf), bool)
        for i, j in g.pairs(20_000):
            ok = g.owned(i, j)
            i, j = i[ok], j[ok]
            ok = (sig[i] == sig[j]).sum(axis=1) >= least
            live[i[ok]] = live[j[ok]] = True
        return table.drop_columns(["sig"]).take(pa.array(g.order[live]))

    return task


def set_task(size: int):
    """Shingle ids of each chosen text, packed, beside its places."""

    def task(batches):
        for part in parts_of(batches):
            ids, first = shingle_sets(*flat(part.column("text")), size)
            ids = ids.astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": part.column("rep"),
                    "places": part.column("places"),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                }
            )

    return task


def overlaps(ids: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common ids of the pairs of a node; ids that only one set has are dropped first, the others counted in blocks."""
    if len(i) <= 2 * len(ids):
        return np.array([len(np.intersect1d(ids[a], ids[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    values, column, count = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(ids), len(ids)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((len(ids), min(4096, width - a)), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def link_task(threshold: float):
    """Links of each row among the pairs that its node owns, and the smallest set it hangs together with there."""

    def task(table: pa.Table) -> pa.Table:
        g = Group(table)
        buf, offsets = flat(table.column("ids"))
        data = np.frombuffer(buf.tobytes(), np.int64)
        ids = [data[offsets[k] // 8 : offsets[k + 1] // 8] for k in g.order.tolist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        links, root = np.zeros(len(ids), np.int64), g.rep.copy()
        ends = np.append(g.begin[1:], len(ids))
        for a, b in zip(g.begin.tolist(), ends.tolist(), strict=True):
            i, j = np.triu_indices(b - a, 1)
            ok = g.owned(i + a, j + a)
            i, j = i[ok], j[ok]
            # a pair can only reach the threshold if its sizes are close enough
            small, large = np.minimum(sizes[a + i], sizes[a + j]), np.maximum(sizes[a + i], sizes[a + j])
            ok = small >= threshold * large - 1e-9
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            common = overlaps(ids[a:b], i, j)
            ok = common >= threshold * (sizes[a + i] + sizes[a + j] - common) - 1e-9
            i, j = i[ok] + a, j[ok] + a
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            while len(i):
                least = np.minimum(root[i], root[j])
                if (root[i] == least).all() and (root[j] == least).all():
                    break
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(g.rep[some]), "root": pa.array(root[some]), "links": pa.array(links[some])})

    return task


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    size: int = 5,
    limit: int = 200,
    missed: float = 1e-5,
    buckets: int | None = None,
) -> DataFrame:
    """Classes and links of texts whose sets of ``size``-word shingles have a Jaccard similarity of at least ``threshold``.

    One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of the texts that links connect), ``copy_of``
    (smallest id with the same shingle set), ``n_links`` (other sets that its set is linked with) and ``n_copies`` (rows
    with its set). ``limit`` is the size up to which a node is compared as it is, and the block size beyond it.
    ``missed`` bounds the chance to miss a pair at the threshold; pairs with more in common are missed more rarely.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer than ``size`` words has one shingle of all its words. Null,
    empty and blank texts have the empty set and are copies of each other. A null id counts as the smallest; rows that
    share an id but not a text are judged each by its own text. Other columns are ignored; an empty table gives an empty
    result.
    """
    return near_duplicate_rows(docs, threshold, size, limit, missed, buckets).drop("key", "t1", "t2", "class_node")


def with_row_key(docs: DataFrame, mark: str = "") -> DataFrame:
    """``docs`` with ``key`` (the id, a null as the smallest), ``t1`` and ``t2`` (text hashes), which name each id and text.

    ``mark`` precedes the three names.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumns(
        {f"{mark}key": F.coalesce(doc_id, F.lit(NULL_ID)), f"{mark}t1": F.xxhash64(text), f"{mark}t2": F.xxhash64(F.lit(1), text)}
    )


def near_duplicate_rows(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, limit: int = 200, missed: float = 1e-5, buckets: int | None = None
) -> DataFrame:
    """Rows of ``near_duplicates`` with ``key, t1, t2`` of each (``with_row_key``) and ``class_node``, one number a class.

    Sets are joined and linked by numbers of their own; ids, which may be null or shared, are only reported.
    """
    runs = runs_for(threshold, 2, missed)
    texts = with_row_key(texts_of(docs))
    schema = SKETCH_SCHEMA.replace("k1 binary, k2 binary", "k1 array<long>, k2 array<long>")
    sketches = pinned(texts.select("key", "t1", "t2", "text").mapInArrow(lean(sketch_task(size, runs)), schema))
    # all columns but those that name the row are functions of the set
    classes = sketches.groupBy("h1", "h2").agg(
        F.min("key").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n")
    )
    classes = pinned(classes.withColumn("rep", F.monotonically_increasing_id()))
    own = classes.where("n > 0").select("h1", "h2", F.col("least_id").alias("key"), "rep")
    named = sketches.join(own, ["h1", "h2", "key"])
    reps = named.select("rep", "sig", "k1", "k2").dropDuplicates(["rep"])
    walked = reps.select("rep", F.posexplode(F.arrays_zip("k1", "k2")).alias("run", "k")).select("rep", "run", "k.k1", "k.k2")
    crowded = walked.groupBy("k1").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select("k1", F.lit(True).alias("deep"))
    leaves = walked.join(crowded, "k1", "left").select("rep", "run", F.when(F.col("deep"), F.col("k2")).otherwise(F.col("k1")).alias("leaf"))
    leaves = pinned(leaves)
    nodes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("run", "leaf"))).alias("l")).select("rep", F.col("l.leaf").alias("leaves"))
    met = leaves.join(nodes, "leaf").withColumn("blocks", F.ceil(F.col("c") / limit).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a set of block b meets every other block once and its own block by itself
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).select(
        "leaf", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        F.col("block").alias("side"), "run", "rep",
    )
    wide = met.join(reps.select("rep", "sig").join(lists, "rep"), "rep")
    if buckets is None:
        buckets = prime_at_least(-(-leaves.count() // 20_000))
    node = F.pmod(F.xxhash64("leaf", "bi", "bj"), F.lit(buckets)).alias("node")
    columns = [n.split()[0] for n in MEMBER.split(", ")]
    near = pinned(wide.groupBy(node).applyInArrow(lean(near_task(threshold)), MEMBER))
    places = near.groupBy("rep").agg(F.collect_list(F.struct("leaf", "bi", "bj", "side", "run")).alias("l"), F.any_value("leaves").alias("leaves"))
    chosen = places.select("rep", F.struct("l", "leaves").alias("places"))
    place_type = "struct<l:array<struct<leaf:long,bi:int,bj:int,side:int,run:int>>,leaves:array<long>>"
    # any row of a set's smallest id that has the set can give its text
    chosen = chosen.join(named.select("rep", "key", "t1", "t2").dropDuplicates(["rep"]), "rep")
    with_text = texts.join(chosen, ["key", "t1", "t2"]).dropDuplicates(["rep"])
    sets = with_text.mapInArrow(lean(set_task(size)), f"rep long, places {place_type}, ids binary")
    rows = sets.select("rep", "ids", F.col("places.leaves").alias("leaves"), F.explode("places.l").alias("p")).select(
        *[F.col(f"p.{c}").alias(c) for c in ("leaf", "bi", "bj", "side", "run")], "rep", "leaves", "ids"
    )
    links = rows.select(*columns, "ids").groupBy(node).applyInArrow(lean(link_task(threshold)), "rep long, root long, links long")
    links = pinned(links)
    linked = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("n_links"))
    found = classes.join(counts.join(linked, "node", "left"), F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", "least_id", "copies", F.coalesce("component", "rep").alias("class_node"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    heads = found.groupBy("class_node").agg(F.min("least_id").alias("class"))
    found = found.join(heads, "class_node")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return sketches.select("key", "t1", "t2", "h1", "h2").join(found, ["h1", "h2"]).select(
        back("key").alias("doc_id"),
        back("class").alias("class_id"),
        back("least_id").alias("copy_of"),
        "n_links",
        F.col("copies").cast("long").alias("n_copies"),
        "key",
        "t1",
        "t2",
        "class_node",
    )
