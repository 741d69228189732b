"""One-permutation near duplicates against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.llm import onehash
from gridpulse.llm.spark import salted_join

SCHEMA = "doc_id long, text string, key string, node string, component string, n string"
rng = random.Random(7)
WORDS = [f"w{i}" for i in range(3_000)]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, size=2):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, common in met.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    heads = {}
    for i in range(len(rows)):
        heads[root(i)] = min(heads.get(root(i), key(i)), key(i))
    for i, (doc_id, _) in enumerate(rows):
        head = heads[root(i)]
        head = head[1] if head[0] else None
        yield doc_id, len(sets[i]), head, doc_id == head


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = [tuple(r) for r in onehash.near_duplicate_components(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(base, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())


def test_awkward_rows(spark):
    base, long = text(80), text(30_000)
    rows = [
        (1, base), (2, base.upper()), (3, changed(base, 0.03)), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "One"), (9, "two words"),
        (None, "null id"), (None, base + " tail"), (None, None), (10, "null  id"), (11, long), (12, long + " more"), (11, text(20)),
        (1, base), (1, base), (13, "é " * 40), (14, "É " * 40), (15, "a b " * 30),
    ]
    check(spark, rows)


def test_large_groups_of_near_copies(spark):
    """Copies near the original, copies of copies that drift away, and unlike texts around one template."""
    first, second, template = text(150), text(12), text(150)
    rows = [(i, changed(first, 0.04)) for i in range(60)] + [(200 + i, changed(second, 0.05)) for i in range(30)]
    drift = text(200)
    for i in range(30):
        drift = changed(drift, 0.03)
        rows.append((300 + i, drift))
    rows += [(400 + i, f"{template} {text(70)}") for i in range(30)]
    rng.shuffle(rows)
    check(spark, rows, few=12)


def test_empty_table(spark):
    assert onehash.near_duplicate_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 12, 40, 400])
def test_filled_bins_estimate_the_similarity(size):
    numbers = np.random.default_rng(size)
    estimates, exact = [], []
    for _ in range(200):
        a = np.unique(numbers.integers(0, 2**48, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(size * 0.9))], numbers.integers(0, 2**48, size // 10, dtype=np.uint64)]))
        out = onehash.one_permutation(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        estimates.append((out[0] == out[1]).mean())
        exact.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(estimates) - np.mean(exact)) < 0.02


def test_looking_up_and_probing_fill_alike():
    numbers = np.random.default_rng(2)
    ids = np.unique(numbers.integers(0, 2**48, 12, dtype=np.uint64))
    first = np.array([0, len(ids)])
    assert (onehash.one_permutation(ids, first, few=0) == onehash.one_permutation(ids, first, few=64)).all()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_join(spark, how):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    want = sorted(map(str, left.join(right, ["k"], how).select("k", "id", "x").collect()))
    got = salted_join(left, right, ["k"], how=how, crowd=20).select("k", "id", "x").collect()
    assert sorted(map(str, got)) == want


@pytest.mark.parametrize("size", [3, 30, 150, 900, 6_000])
def test_marks_keep_every_link_and_rule_out_most_others(size):
    numbers = np.random.default_rng(size)
    kept = {}
    for similarity in (0.8, 0.65):
        common = -(-2 * size * similarity // (1 + similarity))
        pairs = [numbers.choice(2**48, size=2 * size, replace=False).astype(np.uint64) for _ in range(60)]
        sides = [(np.sort(p[:size]), np.sort(np.concatenate([p[: int(common)], p[size : 2 * size - int(common)]]))) for p in pairs]
        ids, first = np.concatenate([s for pair in sides for s in pair]), np.arange(121) * size
        marks = np.hstack([onehash.mix(onehash.one_permutation(ids, first).astype(np.uint64)).astype(np.uint8), onehash.odd_sketch(ids, first)])
        n = np.full(60, size)
        kept[similarity] = len(onehash.may_link(marks[::2], marks[1::2], n, n, 80))
    assert kept[0.8] == 60
    assert kept[0.65] == 0 or size < 100 or size > 3_000


def test_a_crowded_bucket_loses_no_link(spark):
    """One bucket for all: 40 pairs of just over 80 % that no hub of the first turn joins."""
    own = random.Random(11)
    bases = [[f"c{own.randrange(10**9)}" for _ in range(41)] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)] + [(100 + i, " ".join([*b[:37], *(f"e{i}-{j}" for j in range(4))])) for i, b in enumerate(bases)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = onehash.with_row_key(onehash.texts_of(docs))
    nodes = texts.select("key", "t1", "t2", "text").mapInArrow(onehash.sketch_task(2), onehash.SKETCH)
    nodes = onehash.stored(nodes.withColumns({"node": F.col("key"), "bands": F.array(F.lit(1).cast("long"))}))
    linked = onehash.linked_sets(nodes, texts, 2, 80, few=2)
    assert {(r["node"], r["component"]) for r in linked.collect()} == {(i + d, i) for i in range(40) for d in (0, 100)}
