"""Counting the grams of a task: right sums, in memory that is little over what the task holds."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from gridpulse.llm import blocks


def texts(n):
    return pa.RecordBatch.from_pydict({"text": ["text"] * n})


def summed(found):
    total = Counter()
    for batch in found:
        for gram, n in zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist(), strict=True):
            total[gram] += n
    return total


def test_counts_add_up_over_many_small_steps():
    rng = np.random.default_rng(3)
    drawn = [rng.integers(0, 2**64, 30, np.uint64)[rng.integers(0, 30, int(n))] for n in rng.integers(0, 60, 40)]
    drawn += drawn[:20]
    cutter, expected = blocks.Cutter(6, 1), Counter()
    for units in drawn:
        expected.update(cutter.grams(units)[0].view(np.int64).tolist())
    for most, step in ((4_000_000, 1 << 19), (4_000_000, 1), (5, 7)):
        left = iter(drawn)

        def units_of(part, left=left):
            units = next(left)
            return units, np.array([0, len(units)])

        task = blocks.gram_counts(units_of, 6, 1, each=1, least=1, most=most, step=step)
        assert summed(task(iter([texts(25), texts(35)]))) == expected


def test_no_texts_give_no_grams():
    task = blocks.gram_counts(lambda part: (np.zeros(0, np.uint64), np.zeros(2, np.int64)), 13, 4, each=1, least=8)
    assert summed(task(iter([]))) == summed(task(iter([texts(3)]))) == Counter()


def test_a_task_takes_little_more_memory_than_the_grams_it_holds():
    rng = np.random.default_rng(4)
    task = blocks.gram_counts(
        lambda part: (rng.integers(0, 2**64, 200_000, np.uint64), np.array([0, 200_000])), 13, 4, each=1, least=8
    )
    tracemalloc.start()
    try:
        assert not summed(task(iter([texts(40)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6  # 4.5 million grams and counts are 72 MB; all of them sorted anew at each step took over 300 MB
