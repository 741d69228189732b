"""op10_benchmark_leaks on an item made only of words that most passages have."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from gridpulse.llm import leaks


def test_verbatim_item_of_frequent_words(spark):
    rng = random.Random(4)
    common = ["the", "city", "is", "on", "a", "river", "and", "it", "was", "old"]
    rare = [f"rare{i}" for i in range(30)]
    item, other = "is the old city on a river", " ".join(rare)
    docs = [(i, " ".join(rng.sample(common, 10) + [rng.choice(common) for _ in range(30)])) for i in range(400)]
    docs.append((1000, f"{' '.join(rare[:20])} {item} {' '.join(rare[20:])}"))
    docs.append((1001, f"unseen words {item} then others"))
    benchmark = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in found}
    assert got[1000, 1] > 0.99 and got[1001, 1] > 0.99


def test_pair_counts_of_a_task_are_added_up_before_they_leave_it(monkeypatch):
    """Every pair of words once a task, with the counts of all its texts, unless there are too many unlike pairs."""
    item = "red green blue white black grey"
    items = leaks.Items([(1, item)], 5)
    monkeypatch.setattr(leaks, "received", lambda shared: shared)
    batch = pa.RecordBatch.from_pydict({"text": [item, f"{item} red"] * 50})
    plain = {}
    for rows in leaks.pair_task(items, 1 << 20)([batch]):
        for i, j, n in zip(*(rows.column(c).to_pylist() for c in "ijn"), strict=True):
            plain[i, j] = plain.get((i, j), 0) + n
    parts = list(leaks.pair_task(items, 16)([batch] * 3))
    got = [(i, j) for rows in parts for i, j in zip(rows.column("i").to_pylist(), rows.column("j").to_pylist(), strict=True)]
    assert sorted(got) == sorted(plain)
    assert sum(sum(rows.column("n").to_pylist()) for rows in parts) == 3 * sum(plain.values())


def test_texts_are_read_once_for_a_block_of_items(spark):
    """The passes after the first read stored hits, which are gone in the end; each pass read all texts before."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    item = "red green blue white black grey pink"
    docs = spark.createDataFrame([(1, f"so {item} on"), (2, None), (None, item), (3, "green"), (4, "")], "doc_id long, text string")
    found = leaks.leaks(docs.mapInArrow(counted, docs.schema), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 7), (None, 7)}
    assert read.value == 5
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_stored_hits_are_those_of_the_texts(monkeypatch):
    """Also of texts without hits or words, and with long ways between hits."""
    monkeypatch.setattr(leaks, "received", lambda shared: shared)
    items = leaks.Items([(1, "red green blue white black")], 5)
    rng = random.Random(3)
    texts = [" ".join(["no"] * rng.choice([0, 1, 254, 255, 256, 70_000]) + rng.choices(["red", "blue", "no"], k=rng.randrange(5))) for _ in range(60)]
    texts += ["", "no " * 99, "green", " ".join(["white"] + ["no"] * 254 + ["white"] + ["no"] * 255 + ["black"])]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": [None, *range(1, n)], "t1": [*range(n)], "t2": [*range(n)], "text": texts})
    stored = list(leaks.hit_task(items.vocabulary)([batch]))

    def listed(batches, most):
        rows = []
        for part, text, word, ids, words in leaks.hits(items.vocabulary, batches, most):
            doc = part.column("doc_id").to_pylist()
            of = text.tolist()
            for i in range(part.num_rows):
                own = [(w, v) for t, w, v in zip(of, word.tolist(), ids.tolist(), strict=True) if t == i]
                rows.append((doc[i], int(words[i]), own))
        return rows

    assert listed([batch], 1 << 20) == listed(stored, 1 << 20) == listed(stored, 1000)
    assert max(len(words) for *_, words in leaks.hits(items.vocabulary, stored, 1000)) < n


def test_only_candidates_that_share_enough_words_are_aligned():
    """The bound is the weight of the words that an item and some hits share, each counted as often as both have it."""
    items = leaks.Items([(1, "red red green blue white"), (2, "white black grey pink brown")], 5)
    items.weigh({i: i for i in range(len(items.vocabulary))}, 50)
    first, second = items.words
    ids = np.concatenate([first, first[:1], second, first[2:3]])
    spans = [(0, 0, 5), (0, 0, 6), (0, 5, 12), (1, 0, 5), (1, 6, 6), (1, 0, 12)]
    got = items.most_common(*(np.array(c) for c in zip(*spans, strict=True)), ids)
    for (item, lo, hi), weight in zip(spans, got.tolist(), strict=True):
        shared = Counter(items.words[item].tolist()) & Counter(ids[lo:hi].tolist())
        assert abs(weight - sum(items.idf[w] * k for w, k in shared.items())) < 1e-9
