import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.functions.projection import TransverseMercator, to_lon_lat
from gridpulse.operators import spatial as X
from gridpulse.operators import stats as T
from gridpulse.scale import exact_quantiles, global_position


def test_global_position_matches_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(2000)]
    out = global_position(spark.createDataFrame(rows, "k int, i int"), ["k", "i"], "p").orderBy("p").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["i"]) for r in out] == want and [r["p"] for r in out] == list(range(1, 2001))


def test_exact_quantiles_with_a_hot_value(spark):
    values = [7.0] * 700 + [float(i) / 3 for i in range(1400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(frame, "v", [0.05, 0.3333, 0.5, 0.95]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.05, 0.3333, 0.5, 0.95])))


def test_nearest_reference_matches_brute_force(spark):
    rng = random.Random(3)
    refs = [(f"r{i}", rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(60)] + [("far", 40.0, -30.0), ("r0b", 5.0, 5.0)]
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(80)] + [(100 + i, 0.0, 0.0) for i in range(40)]
    out = X.nearest_reference(
        spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(refs, "label string, ref_x double, ref_y double"), "x", "y", "label"
    ).collect()
    assert len(out) == len(points)
    for r in out:
        best = min(math.hypot(r["x"] - x, r["y"] - y) for _, x, y in refs)
        assert r["distance"] == pytest.approx(best, abs=1e-12)


def test_nearest_without_references(spark):
    none = spark.createDataFrame([], "label string, ref_x double, ref_y double")
    row = X.nearest_reference(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), none, "x", "y", "label").first()
    assert row["label"] is None


def test_points_near_segments_matches_brute_force(spark):
    rng = random.Random(9)
    segs = [(i, *(rng.uniform(-1, 1) for _ in range(4))) for i in range(30)] + [(99, 0.5, 0.5, 0.5, 0.5)]
    pts = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(200)]

    def dist(p, s):
        (px, py), (x1, y1, x2, y2) = p, s
        d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
        f = 0 if d2 == 0 else max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d2))
        return math.hypot(px - x1 - f * (x2 - x1), py - y1 - f * (y2 - y1))

    want = {(s[0], p[0]) for s in segs for p in pts if dist(p[1:], s[1:]) < 0.08}
    got = X.points_near_segments(
        spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(segs, "sid int, x1 double, y1 double, x2 double, y2 double"),
        {"id": "id", "x": "x", "y": "y"}, {"id": "sid", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, radius=0.08, cell=0.15,
    )
    rows = [(r["segment_id"], r["point_id"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_downstream_ends_on_cycles_and_keeps_isolated_source(spark):
    segs = spark.createDataFrame([("a", "b", 1, "s1"), ("c", "b", 2, "s2"), ("c", "a", 1, "s3"), ("x", "y", 1, "s4")], "p string, q string, o int, code string")
    edges = X.directed_edges(segs, "p", "q", "o", "code")
    reached = X.downstream(edges, spark.createDataFrame([("a",), ("z",)], "source string"))
    assert {tuple(r) for r in reached.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")}
    assert {r["code"] for r in X.downstream_segments(reached, edges).collect()} == {"s1", "s2", "s3"}


def test_far_cluster_meets_few_references(spark):
    """Points far from a tight cluster of many references, beside one outlier, visit a few leaves each."""
    refs = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("label"), (F.col("id") % 317 * 1e-6).alias("ref_x"), (F.floor(F.col("id") / 317) * 1e-6).alias("ref_y")
    ).unionByName(spark.createDataFrame([("out", 90.0, 90.0)], "label string, ref_x double, ref_y double"))
    points = spark.range(200).select("id", (F.lit(40.0) + F.col("id") % 20 * 0.01).alias("x"), (F.lit(20.0) + F.floor(F.col("id") / 20) * 0.02).alias("y"))
    met = X.nearest_candidates(points, refs, "x", "y", "label").groupBy("_x", "_y").count().agg(F.max("count"), F.count("*")).first()
    assert met[0] < 100 and met[1] == 200
    corner = X.nearest_reference(points, refs, "x", "y", "label").select("label", "distance", F.sqrt(F.pow(F.col("x") - 316e-6, 2) + F.pow(F.col("y") - 314e-6, 2)).alias("d"))
    rows = corner.collect()
    assert len(rows) == 200 and all(r["distance"] <= r["d"] + 1e-9 and r["distance"] > r["d"] - 2e-6 for r in rows)


def test_nearest_ties_nulls_and_shared_places(spark):
    refs = [("b", 1.0, 0.0), ("a", -1.0, 0.0), ("c", 1.0, 0.0), ("n", None, 0.0), ("i", float("inf"), 0.0)]
    points = [(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, 0.0)]
    out = X.nearest_reference(
        spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(refs, "label string, ref_x double, ref_y double"), "x", "y", "label", leaf=1
    )
    assert {r["id"]: (r["label"], r["distance"]) for r in out.collect()} == {1: ("a", 1.0), 2: (None, None), 3: (None, None), 4: ("b", 0.0)}


def test_long_diagonal_crosses_thousands_of_cells(spark):
    line = spark.createDataFrame([(0.0, 0.0, 30.0, 30.0)], "_x1 double, _y1 double, _x2 double, _y2 double")
    assert X.crossed_cells(line, 0.001, F.lit(0.01)).count() < 13_000
    pts = [(i, i * 0.1, i * 0.1 + (0.0005 if i % 2 else 0.01)) for i in range(300)]
    segs = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 30.0), (2, 0.0, 0.0, 0.0, 0.05), (3, 7.0, 0.0, 7.0, 20.0)], "sid int, x1 double, y1 double, x2 double, y2 double")
    got = X.points_near_segments(
        spark.createDataFrame([*pts, (-1, None, 1.0)], "id int, x double, y double"), segs,
        {"id": "id", "x": "x", "y": "y"}, {"id": "sid", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, radius=0.001,
    )
    rows = {(r["segment_id"], r["point_id"]) for r in got.collect()}
    assert rows == {(1, i) for i, _, _ in pts if i % 2} | {(2, 0), (3, 70)}


@pytest.mark.parametrize("widths", [1, 3])
def test_crossed_cells_lose_no_pair_at_any_slope_and_width(spark, widths):
    rng = random.Random(21)
    segs = [(i, *(rng.uniform(-2, 2) for _ in range(4))) for i in range(20)] + [(50, -1.0, -2.0, -1.0, 2.0), (51, -2.0, 1.0, 2.0, 1.0)]
    pts = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(400)]

    def dist(p, s):
        (px, py), (x1, y1, x2, y2) = p, s
        f = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(px - x1 - f * (x2 - x1), py - y1 - f * (y2 - y1))

    got = X.points_near_segments(
        spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(segs, "sid int, x1 double, y1 double, x2 double, y2 double"),
        {"id": "id", "x": "x", "y": "y"}, {"id": "sid", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, radius=0.05, cell=0.02, most_columns=8, widths=widths, factor=4,
    )
    rows = [(r["segment_id"], r["point_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(s[0], p[0]) for s in segs for p in pts if dist(p[1:], s[1:]) < 0.05}


def test_long_chain_takes_few_rounds(spark):
    edges = spark.range(5_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("c").alias("code"))
    sources = spark.createDataFrame([(0,), (2_500,)], "source long")
    out = X.downstream(edges, sources, rounds=5).groupBy("source").agg(F.count("*"), F.countDistinct("node"), F.max("node")).orderBy("source").collect()
    assert [tuple(r) for r in out] == [(0, 5_001, 5_001, 5_000), (2_500, 2_501, 2_501, 5_000)]


def test_reachability_equals_a_plain_search(spark):
    """Chains, rings, branches, a source inside a chain and one inside a ring."""
    rng = random.Random(4)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(20)} | {(120, 130), (130, 131), (131, 130), (3, 100)}
    pairs |= {(200, 201), (201, 202), (202, 200), (300, 301), (301, 302), (302, 301)}
    sources = [0, 3, 105, 131, 201, 300, 999]
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    want = set()
    for s in sources:
        seen, todo = {s}, [s]
        while todo:
            for n in ahead.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        want |= {(s, n) for n in seen}
    edges = spark.createDataFrame([(a, b, "c") for a, b in pairs] * 2 + [(None, 1, "c"), (1, None, "c")], "src long, dst long, code string")
    got = [tuple(r) for r in X.downstream(edges, spark.createDataFrame([(s,) for s in [*sources, None]], "source long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_projection_inverts_an_independent_forward_formula(spark):
    crs = TransverseMercator()

    def forward(lon, lat):
        e, k = crs.ecc, crs.scale
        ep = e / (1 - e)
        p = math.radians(lat)
        n = crs.axis / math.sqrt(1 - e * math.sin(p) ** 2)
        t, c = math.tan(p) ** 2, ep * math.cos(p) ** 2
        a = math.radians(lon - crs.longitude) * math.cos(p)
        x = k * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120)
        m = crs.arc(p) - crs.arc(math.radians(crs.latitude))
        y = k * (m + n * math.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
        return crs.east + x, crs.north + y

    places = [(crs.longitude, crs.latitude), (-75.5, 5.07), (-76.2, 4.8), (-77.9, 6.3)]
    rows = [(*forward(*p), *p) for p in places]
    lon, lat = to_lon_lat(F.col("x"), F.col("y"))
    for r in spark.createDataFrame(rows, "x double, y double, lon double, lat double").select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-8) and r["b"] == pytest.approx(r["lat"], abs=1e-8)


def test_stratified_split_is_exact_per_stratum(spark):
    frame = spark.createDataFrame([(i, "hot" if i % 10 else "cold") for i in range(1000)], "id int, g string")
    out = T.stratified_split(frame, "g", "id", {"train": 0.8, "test": 0.2}).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in out} == {("hot", "train"): 720, ("hot", "test"): 180, ("cold", "train"): 80, ("cold", "test"): 20}


def test_histogram_of_constant_and_empty_column(spark):
    one = T.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 30).where("n > 0").collect()
    assert len(one) == 1 and one[0]["probability"] == 1.0
    assert T.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_histogram_leaves_out_what_is_not_finite(spark):
    rows = T.histogram(spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (float("inf"),), (None,)], "v double"), "v", 2).collect()
    assert sorted((r["bin"], r["n"], r["probability"]) for r in rows if r["bin"] is not None) == [(0, 1, 0.5), (1, 1, 0.5)]
    assert [r["n"] for r in rows if r["bin"] is None] == [2]


def test_regression_errors(spark):
    row = T.regression_errors(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "a double, p double"), "a", "p").first()
    assert row["mse"] == pytest.approx(2 / 3) and row["mape"] == pytest.approx(25.0) and row["r2"] == pytest.approx(1 - 2 / (42 / 9))


def test_class_codes_sorted(spark):
    out = T.class_codes(spark.createDataFrame([("b",), ("a",), ("b",)], "c string"), "c").orderBy("code").collect()
    assert [tuple(r) for r in out] == [("a", 0, 1), ("b", 1, 2)]


@pytest.mark.parametrize("task_pairs", [50, 500])
def test_a_crowded_distance_join_is_dealt_by_its_pairs(spark, task_pairs):
    own = random.Random(3)
    dots = [(i, own.uniform(0, 0.6), own.uniform(0, 0.2)) for i in range(150)]
    lines = [(i, x := own.uniform(0, 0.6), y := own.uniform(0, 0.2), x + own.choice([0, 0.05, -0.1]), y + own.choice([0, 0.04])) for i in range(80)]
    near = X.points_near_segments(
        spark.createDataFrame(dots, "id long, x double, y double"), spark.createDataFrame(lines, "sid long, x1 double, y1 double, x2 double, y2 double"),
        {"id": "id", "x": "x", "y": "y"}, {"id": "sid", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, radius=0.03, cell=0.2, task_pairs=task_pairs,
    )
    want = {}
    for i, px, py in dots:
        for s, x1, y1, x2, y2 in lines:
            dx, dy = x2 - x1, y2 - y1
            along = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if (d := math.hypot(px - x1 - along * dx, py - y1 - along * dy)) < 0.03:
                want[s, i] = d
    rows = near.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["segment_id"], r["point_id"]) for r in rows} == set(want) and len(rows) == len(want)
    assert all(abs(r["distance"] - want[r["segment_id"], r["point_id"]]) < 1e-9 for r in rows)
    assert len({r["task"] for r in rows}) > 4
