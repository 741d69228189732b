"""Prefix trie of conversations, as node rows.

Turns are hashed where they are read. A prefix of a conversation is named by the exclusive-or of 128-bit hashes of its turns
and their places, so any stretch of a conversation can be digested by itself and stretches combine. Shards hold stretches
of whole families of conversations. A shard enumerates its distinct prefix digests and gives each a slot by a minimal perfect
hash that is checked against the stored digests; member counts are scattered into flat arrays by slot. Spark adds the
shards' partial nodes up. Each node then belongs to its smallest member, whose shard scatters the node's tokens, leaves and
children into its slots and accumulates them through an array of parent slots, deepest first; the shards' sums are added up
again. No step needs all conversations of a node, or all turns of a conversation, in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.arrays import lean, mix
from gridpulse.llm.spark import numbered, pinned, prime_at_least

FAMILY, LEADS = 5, 9
STEP = "shard long, conv long, block long, depth long, e1 long, e2 long, size long, length long"
PART = "d1 long, d2 long, kind int, depth long, p1 long, p2 long, conv long, n long, ends long, size long"
SUMS = "d1 long, d2 long, saved long, leaves long, children long"
NO_ENDS = hashlib.sha256().hexdigest()


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys: each key alone in its place keeps it, the others hash again."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, slot, left, given = [], np.empty(len(a), np.int64), np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            width = 2 * len(left)
            place = self._place(a[left], b[left], len(self.levels), width)
            alone = np.bincount(place, minlength=width) == 1
            rank = given + np.cumsum(alone) - alone
            self.levels.append((width, alone, rank))
            ok = alone[place]
            slot[left[ok]] = rank[place[ok]]
            given += int(alone.sum())
            left = left[~ok]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix(a ^ mix(b + np.uint64(level))) % np.uint64(width)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.a)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table does not hold (the stored key decides)."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (width, alone, rank) in enumerate(self.levels):
            place = self._place(a[left], b[left], level, width)
            ok = alone[place]
            out[left[ok]] = rank[place[ok]]
            left = left[~ok]
        held = np.flatnonzero(out >= 0)
        wrong = held[(self.a[out[held]] != a[held]) | (self.b[out[held]] != b[held])]
        out[wrong] = -1
        return out


def slots_of(a: np.ndarray, b: np.ndarray) -> tuple[SlotTable, np.ndarray]:
    """Table of the distinct keys and the slot of each row."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    table = SlotTable(a[order[new]], b[order[new]])
    return table, table.find(a, b)


class Shard:
    """Stretches of conversations with the digest ``d1, d2`` of every prefix and of its parent ``p1, p2``."""

    def __init__(self, table: pa.Table, block: int):
        get = lambda c: table.column(c).to_numpy()
        conv, depth, stretch, size = get("conv"), get("depth"), get("block"), get("size")
        order = np.lexsort((depth, stretch, conv))
        conv, depth, stretch, size = conv[order], depth[order], stretch[order], size[order]
        starts = np.ones(len(conv), bool)
        starts[1:] = (conv[1:] != conv[:-1]) | (stretch[1:] != stretch[:-1])
        number = np.cumsum(starts) - 1
        # a row of negative size only hands on the digest that the stretch begins with
        real = np.flatnonzero(size >= 0)
        digests = []
        for name in ("e1", "e2"):
            e = get(name)[order].view(np.uint64)
            run = np.bitwise_xor.accumulate(e) if len(e) else e
            before = np.concatenate([[np.uint64(0)], run])[:-1][starts] if len(e) else e
            whole = run ^ before[number] if len(e) else e
            digests += [whole[real], (whole ^ e)[real]]
        self.d1, self.p1, self.d2, self.p2 = digests
        self.conv, self.depth, self.size, self.length = conv[real], depth[real], size[real], get("length")[order][real]
        self.table, self.slot = slots_of(self.d1, self.d2)
        n = len(self.table)
        #: any row of a node tells its depth, size and parent
        self.row = np.zeros(n, np.int64)
        self.row[self.slot] = np.arange(len(real))
        self.node_depth = self.depth[self.row]
        self.parent = self.table.find(self.p1[self.row], self.p2[self.row])
        self.parent[(self.node_depth == 0) | ((self.node_depth > 1) & ((self.node_depth - 1) % block == 0))] = -1

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, as far as this shard holds them."""
        order = np.argsort(self.node_depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.node_depth[order])) + 1
        for slots in reversed(np.split(order, cuts)):
            slots = slots[self.parent[slots] >= 0]
            np.add.at(values, self.parent[slots], values[slots])
        return values


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def enumerate_task(block: int):
    """Partial nodes of a shard (kind 0), and the node at which each of its conversations ends (kind 1)."""

    def task(table: pa.Table) -> pa.Table:
        s = Shard(table, block)
        n, at = len(s.table), s.row
        count = np.bincount(s.slot, minlength=n)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, s.slot, s.conv)
        over = np.flatnonzero(s.depth == s.length)
        ends = np.bincount(s.slot[over], minlength=n)
        both = lambda x, y: np.concatenate([x, y]).astype(np.int64)
        none = np.zeros(len(over), np.int64)
        return pa.table(
            {
                "d1": both(signed(s.table.a), signed(s.d1[over])),
                "d2": both(signed(s.table.b), signed(s.d2[over])),
                "kind": both(np.zeros(n), none + 1).astype(np.int32),
                "depth": both(s.node_depth, s.depth[over]),
                "p1": both(signed(s.p1[at]), none),
                "p2": both(signed(s.p2[at]), none),
                "conv": both(least, s.conv[over]),
                "n": both(count, none),
                "ends": both(ends, none),
                "size": both(s.size[at], none),
            }
        )

    return task


def accumulate_task(block: int):
    """Partial subtree sums of a shard from the nodes that belong to its conversations."""

    def task(steps: pa.Table, owned: pa.Table) -> pa.Table:
        s = Shard(steps, block)
        n = len(s.table)
        get = lambda c: owned.column(c).to_numpy()
        conv, depth = get("conv"), get("depth")
        names, index = np.unique(s.conv, return_inverse=True)
        width = np.int64(s.depth.max() + 1 if len(s.depth) else 1)
        known = index * width + s.depth
        order = np.argsort(known)
        wanted = np.searchsorted(names, conv) * width + depth
        slot = s.slot[order[np.searchsorted(known[order], wanted)]] if len(wanted) else np.zeros(0, np.int64)
        saved, leaves, children = (np.zeros(n, np.int64) for _ in range(3))
        np.add.at(saved, slot, get("saved"))
        np.add.at(leaves, slot, get("leaves"))
        own = slot[get("own") & (depth > 0)]
        here, away = own[s.parent[own] >= 0], own[s.parent[own] < 0]
        np.add.at(children, s.parent[here], 1)
        saved, leaves = s.up(saved), s.up(leaves)
        some = np.flatnonzero(saved | leaves | children)
        none = np.zeros(len(away), np.int64)
        p1, p2 = s.p1[s.row[away]], s.p2[s.row[away]]
        return pa.table(
            {
                "d1": signed(np.concatenate([s.table.a[some], p1])),
                "d2": signed(np.concatenate([s.table.b[some], p2])),
                "saved": np.concatenate([saved[some], none]),
                "leaves": np.concatenate([leaves[some], none]),
                "children": np.concatenate([children[some], none + 1]),
            }
        )

    return task


def base_of(conv: Column) -> Column:
    return conv - F.pmod(conv, F.lit(FAMILY))


def turn_rows(conversations: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
    )


def rebuilt_steps(conversations: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """A row per rebuilt turn and one per root (depth 0), without shards, and ``conv, length`` of every conversation."""
    turns = numbered(turn_rows(conversations), "conv", ["turn", "a", "b"])
    turns = pinned(turns.select("conv", "place", "members", "a", "b", "size"))
    convs = turns.where("place = 0").select("conv", "members", base_of(F.col("conv")).alias("base"))
    bases = convs.where("conv = base").select("base", F.col("members").alias("base_turns"))
    family = convs.join(bases, "base", "left").withColumn("lead", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(LEADS)))
    family = family.withColumn("taken", F.least("lead", F.coalesce("base_turns", F.lit(0))))
    family = pinned(family.select("conv", "base", "lead", "taken", (F.col("taken") + F.greatest(F.col("members") - F.col("lead"), F.lit(0))).alias("length")))
    own = turns.join(family, "conv").where("place >= lead").withColumn("depth", F.col("place") - F.col("lead") + F.col("taken") + 1)
    firsts = turns.where((F.col("place") < LEADS - 1) & (F.col("conv") == base_of(F.col("conv")))).withColumnRenamed("conv", "base")
    led = firsts.join(family, "base").where("place < lead").withColumn("depth", F.col("place") + 1)
    columns = ["conv", "base", "depth", "a", "b", "size", "length"]
    rows = own.select(*columns).unionByName(led.select(*columns)).select(
        "conv", "base", F.expr(f"(depth - 1) div {block}").alias("block"), "depth",
        F.xxhash64("a", "b", "depth").alias("e1"), F.xxhash64("b", "depth", "a").alias("e2"), "size", "length",
    )
    zero = F.lit(0).cast("long")
    roots = family.select("conv", "base", zero.alias("block"), zero.alias("depth"), zero.alias("e1"), zero.alias("e2"), zero.alias("size"), "length")
    steps = pinned(rows.unionByName(roots))
    # what the stretches before each later stretch of a long conversation come to
    stretches = steps.where(F.col("length") > block).groupBy("conv", "base", "block", "length").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = stretches.select(
        "conv", "base", "block", (F.col("block") * block).alias("depth"), F.bit_xor("e1").over(before).alias("e1"),
        F.bit_xor("e2").over(before).alias("e2"), F.lit(-1).cast("long").alias("size"), "length",
    ).where("block > 0")
    return steps.unionByName(handed), family.select("conv", "length")


def merged_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of all shards; a digest that stands for two unlike prefixes would end the job."""
    same = F.lit(True)
    for c in ("depth", "p1", "p2", "size"):
        same &= F.min(c) == F.max(c)
    checked = F.when(same, F.max("depth")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return parts.where("kind = 0").groupBy("d1", "d2").agg(
        checked.alias("depth"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.min("conv").alias("conv"),
        F.sum("n").alias("n"),
        F.sum("ends").alias("ends"),
        F.max("size").alias("size"),
    )


def owned_rows(nodes: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """What each node adds to its own sums, at its smallest member, and what later stretches add to earlier ones."""
    rows = nodes.select(
        "conv",
        "depth",
        F.expr(f"greatest(depth - 1, 0) div {block}").alias("block"),
        ((F.col("n") - 1) * F.col("size")).alias("saved"),
        (F.col("ends") == F.col("n")).cast("long").alias("leaves"),
        F.lit(True).alias("own"),
    )
    long = lengths.where(F.col("length") > block)
    later = long.select("conv", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("block"))
    added = rows.where("block > 0").groupBy("conv", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.coalesce(c, F.lit(0).cast("long"))).over(after).alias(c) for c in ("saved", "leaves")]
    handed = later.join(added, ["conv", "block"], "left").select("conv", "block", *sums)
    handed = handed.select(
        "conv", (F.col("block") * block).alias("depth"), (F.col("block") - 1).alias("block"), "saved", "leaves", F.lit(False).alias("own")
    )
    return rows.unionByName(handed)


def piece_task(most: int):
    """Sorted ids of each node, joined by commas in pieces of about ``most`` bytes."""

    def task(batches):
        key, ids, size, first = None, [], 0, None
        held: dict[str, list] = {"d1": [], "d2": [], "first": [], "ids": []}

        def close():
            if key is not None:
                for c, v in zip(held, (*key, first, ",".join(ids)), strict=True):
                    held[c].append(v)

        def batch():
            out = pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.string() if c == "ids" else pa.int64()) for c, v in held.items()}
            )
            for v in held.values():
                v.clear()
            return out

        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("d1", "d2", "conv")]
            for d1, d2, conv in zip(*columns, strict=True):
                if key != (d1, d2) or size > most:
                    close()
                    key, ids, size, first = (d1, d2), [], 0, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield batch()
        close()
        yield batch()

    return task


def hash_task(batches):
    """SHA-256 of each node's pieces, which come one after the other."""
    key, state = None, None
    for rows in batches:
        done: list[tuple] = []
        for d1, d2, ids in zip(*[rows.column(c).to_pylist() for c in ("d1", "d2", "ids")], strict=True):
            if key == (d1, d2):
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256()
            state.update(ids.encode())
        yield hashed(done)
    yield hashed([(*key, state.hexdigest())] if key is not None else [])


def hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["d1", "d2", "sha"])


def end_digests(ends: DataFrame, most: int = 8_192) -> DataFrame:
    """``d1, d2, sha``: the ids that end at each node, ascending and joined by commas, hashed.

    Ids are put together to pieces range by range; only pieces of a node meet in one task, which reads them in order and
    holds one batch of them.
    """
    order = ["d1", "d2", "conv"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(lean(piece_task(most)), "d1 long, d2 long, first long, ids string")
    placed = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return placed.mapInArrow(lean(hash_task), "d1 long, d2 long, sha string")


def with_parents(nodes: DataFrame, crowd: int) -> DataFrame:
    """Nodes with the smallest member of their parent; parents of over ``crowd`` children, which are few, are sent to all tasks."""
    heads = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"), "children")
    crowded, others = heads.where(F.col("children") > crowd).drop("children"), heads.where(F.col("children") <= crowd).drop("children")
    below = nodes.where("depth > 0").join(F.broadcast(crowded), ["p1", "p2"], "left")
    top = nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    quiet = below.where("parent is null").drop("parent").join(others, ["p1", "p2"])
    return top.unionByName(below.where("parent is not null")).unionByName(quiet)


def prefix_nodes(conversations: DataFrame, block: int = 65_536, shard_rows: int = 200_000, crowd: int = 10_000) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with the sums of its subtree.

    Conversation c is rebuilt from the first h turns of conversation c - c % 5 (h: unsigned CRC-32 of the decimal id, % 9)
    and its own turns after its first h. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    A null role or text is empty, a null turn comes first; turns of one number are ordered by a hash of role and text, and
    repeated rows are turns like others. Rows without ``conv_id`` belong to no conversation. A remainder is never negative.
    Long texts are read once, where they are hashed. Other columns are ignored. An empty table has no nodes.

    Conversations are cut in stretches of ``block`` turns, shards hold about ``shard_rows`` rows. At most one node in
    ``crowd`` has more than ``crowd`` children, which bounds the one broadcast.
    """
    steps, lengths = rebuilt_steps(conversations, block)
    shards = prime_at_least(-(-steps.count() // shard_rows))
    shard = lambda base, stretch: F.pmod(F.xxhash64(base, stretch), F.lit(shards)).alias("shard")
    columns = [n.split()[0] for n in STEP.split(", ")][1:]
    steps = steps.select(shard(F.col("base"), F.col("block")), *columns)
    parts = pinned(steps.groupBy("shard").applyInArrow(lean(enumerate_task(block)), PART))
    nodes = pinned(merged_nodes(parts))
    owned = owned_rows(nodes, lengths, block)
    owned = owned.select(shard(base_of(F.col("conv")), F.col("block")), "conv", "depth", "saved", "leaves", "own")
    sums = steps.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(lean(accumulate_task(block)), SUMS)
    sums = sums.groupBy("d1", "d2").agg(*[F.sum(c).alias(c) for c in ("saved", "leaves", "children")])
    some = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = nodes.join(sums, ["d1", "d2"], "left").join(end_digests(parts.where("kind = 1")), ["d1", "d2"], "left")
    whole = pinned(whole.select("d1", "d2", "p1", "p2", "depth", "conv", "n", some("children"), some("leaves"), some("saved"), "sha"))
    return with_parents(whole, crowd).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
