"""The prefix trie against a plain trie of whole conversations."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from gridpulse.llm import prefixes
from gridpulse.llm.workload import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, shard string, base long"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in children[seq]) or 1
        size = len(seq[-1][1].encode()) if seq else 0
        saved[seq] = (len(members[seq]) - 1) * size + sum(saved[k] for k in children[seq])
    for seq, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(rebuilt[c]) == len(seq)))
        yield (
            min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), len(children[seq]), leaves[seq], saved[seq],
            hashlib.sha256(ends.encode()).hexdigest(),
        )


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in prefixes.prefix_nodes(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def made(n, longest, choices, seed=3):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]) if t % 2 else "user", f"text {rng.randrange(choices)} é")
        for c in range(n)
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("options", [{}, {"block": 3, "shard_rows": 20, "crowd": 3}])
def test_shared_prefixes(spark, options):
    check(spark, made(120, 8, 2), **options)


def test_long_conversations_in_short_stretches(spark):
    rows = made(15, 60, 1, 5) + [(c, t, "user", f"same {t}") for c in (20, 21, 22, 25) for t in range(40)]
    check(spark, rows, block=4, shard_rows=30)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 1, "user", ""), (1, 0, "user", "x"), (1, 0, "user", "x"),
        (2, 5, "user", "only"), (3, 3, None, "é" * 20_000), (7, 1, "system", "p"), (11, 0, "user", "q"), (-3, 0, "user", "neg"), (-5, 0, "user", "r"),
    ]
    check(spark, rows)
    check(spark, rows, block=1, shard_rows=2)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", f"t{c}") for c in range(1, 40) if c % 5]
    got = check(spark, rows)
    root = next(r for r in got if r[1] == 0)
    assert root[2] is None and root[7] != prefixes.NO_ENDS


def test_one_conversation_many_times(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    got = check(spark, rows, shard_rows=100)
    assert len(got) == 5


def test_empty_table(spark):
    assert prefixes.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5_000, dtype=np.uint64) for _ in range(2))
    held = prefixes.SlotTable(a[:4_000], b[:4_000])
    slots = held.find(a, b)
    assert sorted(slots[:4_000].tolist()) == list(range(4_000)) and (slots[4_000:] == -1).all()
    with pytest.raises(ValueError):
        prefixes.SlotTable(a[[0, 0]], b[[0, 0]])


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")
def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_prefix_trie"](spark, FOLDER).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
