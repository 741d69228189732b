"""Rows that used to get lost, searches that did not end, and storage that other machines cannot see."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridpulse.operators.documents import bounded_memory
from gridpulse.operators.joins import Dimension, star_join
from gridpulse.operators.spatial import nearest_reference
from gridpulse.operators.stats import stratified_split
from gridpulse.session import ensure_checkpoint_dir


def test_split_keeps_rows_without_a_stratum(spark):
    frame = spark.range(100).select(F.col("id"), F.when(F.col("id") % 10 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    out = stratified_split(frame, "s", "id", {"train": 0.5, "test": 0.5})
    assert out.count() == 100
    assert out.where("s is null").groupBy("split").count().count() == 2


def test_messages_of_one_turn_are_all_accounted_for(spark):
    rows = [("c", t, r, f"{r} {t}") for t in range(1, 7) for r in ("user", "assistant")]
    frame = spark.createDataFrame(rows, "conv string, turn int, role string, text string")
    out = bounded_memory(frame, "conv", "turn", "role", "text", turns=2).collect()
    assert len(out) == 5
    digest = next(r for r in out if r["turn_id"].startswith("memory-"))
    assert ": 8 mensajes" in digest["content"] and "4 usuario, 4 asistente" in digest["content"]


def test_nearest_reference_ends_on_points_without_a_finite_place(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 0.0), (3, inf, 1.0), (4, 1e6, 0.0)], "id int, x double, y double")
    refs = spark.createDataFrame([("a", 1.0, 0.0), ("b", 5.0, 0.0), ("c", nan, 0.0)], "label string, rx double, ry double")
    out = nearest_reference(points, refs, "x", "y", "label", "rx", "ry")
    assert {r["id"]: r["label"] for r in out.collect()} == {1: "a", 2: None, 3: None, 4: "b"}


def test_star_join_names_clashing_columns(spark):
    fact = spark.createDataFrame([(1, "f")], "k int, name string")
    side = spark.createDataFrame([(1, "d")], "k int, name string")
    with pytest.raises(ValueError, match="name"):
        star_join(fact, [Dimension(side, {"k": "k"}, ("name",))])


def test_cluster_without_shared_folder_is_refused():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
