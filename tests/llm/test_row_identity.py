"""op2_jaccard_join and its pipeline stage on unlike texts with null or shared ids."""

import random

import pytest

import corpus_pipeline
from gridpulse.llm import jaccard

rng = random.Random(11)
A, B, C, D = (" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(300)) for _ in range(80)) for _ in range(4))
near = lambda text: f"{text} more"
ROWS = [(None, A), (None, B), (7, C), (7, D), (8, near(A)), (9, near(B)), (10, near(C)), (11, near(D)), (12, B), (7, D)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_links_of_unlike_texts_with_one_id(frame):
    got = [tuple(r) for r in jaccard.near_duplicates(frame).collect()]
    want = [(None, None, None, 1, 1), (None, None, None, 1, 2), (12, None, None, 1, 2), (8, None, 8, 1, 1), (9, None, 9, 1, 1),
            (7, 7, 7, 1, 1), (7, 7, 7, 1, 2), (7, 7, 7, 1, 2), (10, 7, 10, 1, 1), (11, 7, 11, 1, 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stage_keeps_one_row_of_each_group(spark, frame):
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, frame, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, A), (None, B), (7, C), (7, D)]))


def test_unlike_texts_of_one_group_with_one_id(spark):
    rows = [(None, A), (None, near(A)), (3, None), (3, ""), (4, C), (4, near(C))]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "4", "None"]
