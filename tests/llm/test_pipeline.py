"""The corpus pipeline, stage by stage, against the plain versions."""

from pathlib import Path

import pytest

import corpus_pipeline
from gridpulse.llm import quality
from gridpulse.llm.workload import table
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        done[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    kept = quality.with_prediction(quality.quality_scores(done["quality"], table(spark, FOLDER, "labels"))).where("predicted = 1")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in pairs(done["near_duplicates"]))
    want = sorted({c for _, c, *_ in brute.near_duplicates(pairs(done["near_duplicates"]))})
    assert sorted(i for i, _ in pairs(done["substring_dedup"])) == want
    words = {i: k for i, _, _, k in brute.substring_dedup(pairs(done["substring_dedup"]))}
    got = {i: " ".join(brute.WORD.findall(t)) for i, t in pairs(done["decontamination"])}
    assert got == {i: k for i, k in words.items() if k}
    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    clean = sorted(i for i, t in pairs(done["decontamination"]) if not any(x in t for x in items))
    assert sorted(i for i, _ in pairs(done["packing"])) == clean
    assert {r["doc_id"] for r in docs.collect()} == set(clean)


def test_stages_take_awkward_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "some words here", "en", "s", 15), (2, "", "en", None, 0), (2, "", "en", None, 0)],
        table(spark, FOLDER, "documents").schema,
    )
    rows = lambda frame: sorted(map(str, pairs(frame)))
    stages = dict(corpus_pipeline.STAGES)
    scored = quality.with_prediction(quality.quality_scores(odd, table(spark, FOLDER, "labels"))).collect()
    accepted = {r["doc_id"] for r in scored if r["predicted"] == 1}  # a row's text follows from its id here, or is empty
    assert rows(stages["quality"](spark, odd, FOLDER)) == sorted(str(d) for d in pairs(odd) if d[0] in accepted)
    assert rows(stages["near_duplicates"](spark, odd, FOLDER)) == sorted(map(str, [(None, "some words here"), (1, None)]))
    assert rows(stages["substring_dedup"](spark, odd, FOLDER)) == [str((None, "some words here"))]
    assert rows(stages["decontamination"](spark, odd, FOLDER)) == rows(odd)
    assert sorted(str(r["doc_id"]) for r in stages["packing"](spark, odd, FOLDER).collect()) == ["1", "2", "2", "None"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0, name


def test_decontamination_keeps_clean_rows_that_share_an_id(spark):
    item = table(spark, FOLDER, "benchmark").orderBy("item_id").first()["text"]
    leak = f"before it {item} after it"
    docs = [(None, "clean one here"), (None, "clean two here"), (None, leak), (7, "clean three"), (7, leak), (8, "clean four")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.without_benchmark_leaks(spark, frame, FOLDER)
    assert sorted(map(str, pairs(got))) == sorted(str(d) for d in docs if d[1] != leak)
