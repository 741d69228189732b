import gzip
import hashlib
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridpulse.operators.aggregates import event_rollup, month_view, daily_impact
from gridpulse.operators import joins as J
from gridpulse.plans import payloads
from gridpulse.plans.gold import StarSources, gold_tables, map_tables, silver_fact, span_assets
from gridpulse.plans.maps import map_layers
from gridpulse.sources import digests as D
from gridpulse.sources import readers as R
from gridpulse.sources import writers as W
from gridpulse.workload import registry


def test_unknown_mode_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        R.read_source(spark, str(tmp_path), "xml")


def test_text_csv_keeps_blanks_and_cuts_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿row_id, name \n1,\n02,NA\n", encoding="utf-8")
    frame = R.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert frame.columns == ["row_id", "name"] and [tuple(r) for r in frame.collect()] == [("1", ""), ("02", "NA")]


def test_merge_files_skips_other_headers(spark, tmp_path):
    for name, text in {"E1.csv": "a;b;c\n1;2;3\n1;2;3\n", "E2.csv": "a;b;c\n4;5;6\n", "E3.csv": "b;a;c\n7;8;9\n"}.items():
        (tmp_path / name).write_text(text)
    out = R.merge_files(spark, [str(p) for p in tmp_path.glob("E*.csv")], drop=["c", "absent"])
    assert sorted(tuple(r) for r in out.frame.collect()) == [("1", "2"), ("4", "5")]
    assert len(out.skipped) == 1 and out.rows_before.first()["rows"] == 3 and out.rows_after.first()["rows"] == 2


def test_inventory_digest_and_availability(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = R.file_inventory(spark, str(tmp_path), digest=True)
    good = hashlib.sha256(b"abc").hexdigest()
    assert files.first()["sha256"] == good
    manifest = spark.createDataFrame([("a.bin", "0" * 64), ("b.bin", good)], "file_name string, sha256 string")
    log = R.availability(manifest, files)
    assert {r["file_name"]: r["status"] for r in log.collect()} == {"a.bin": "DIGEST_MISMATCH", "b.bin": "MISSING"}
    with pytest.raises(FileNotFoundError):
        R.require_available(log)


def test_nested_weather(spark, tmp_path):
    doc = {"city_name": "M", "lat": 5.0, "data": [{"temp": 1.0}, {"temp": 2.0}]}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    out = R.read_nested_weather(spark, str(tmp_path / "w.json"), {"city": "city_name", "lat": "lat"})
    assert sorted(r["temp"] for r in out.collect()) == [1.0, 2.0] and out.first()["city"] == "M"


def test_upsert_and_seed(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, updated_at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, updated_at int")
    assert sorted((r["k"], r["v"]) for r in W.upsert(now, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["k"] for r in W.insert_missing(now, new, ["k"]).collect()] == [3]


def test_overwrite_changes_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    W.write_table(spark.createDataFrame([("y",)], "c string"), path)
    assert spark.read.parquet(path).columns == ["c"]


def test_cleanup_drops_only_allowed(spark):
    spark.sql("drop table if exists keep_me")
    spark.range(1).createOrReplaceTempView("v_keep")
    rows = {r["table"]: r["status"] for r in W.cleanup(spark, ["v_keep", "gone"], [], dry_run=False).collect()}
    assert rows == {"v_keep": "PRESERVED_BLOCKED", "gone": "MISSING"} and spark.catalog.tableExists("v_keep")


@pytest.fixture(scope="module")
def star(spark):
    def frame(rows, cols):
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))

    return StarSources(
        fact=spark.createDataFrame(
            [(1, "EV1", "V1", "T1", "0,5"), (2, "EV1", "V2", "T2", "1.5"), (3, "EV2", "V3", "T9", "")], "row_id long, event_id string, FID_VANO string, trafo_profile_id string, UITI_VANO string"
        ),
        events=frame([("EV1", "2024-01-05 10:00:00", "2,5", "3.0", "40", "2", "C1", "EQ1"), ("EV2", "bad", "1", "1", "7", "1", "C9", "")], "event_id FECHA DURACION UITI TOT_USUS CNT_TRF COD_CAUSA COD_EQ_PROTEGE"),
        spans=frame(
            [("V1", "SW1", "A1", "Manizales", "-75,5", "5,0", "-75.4", "5.1"), ("V2", " ", "A2", "", "-75.5", "5.0", "-75.4", "5.1"), ("V3", "SW7", "A3", None, "-75.5", "5.0", "-75.4", "5.1")],
            "FID_VANO FID_SW FID_APOYO_FIN municipio X1 Y1 X2 Y2",
        ).withColumns({c: F.lit("1") for c in ("LONGITUD", "CONDUCTOR", "TIPO_TAX")}),
        equipment=frame([("SW1", "CIR-1", "Reconectador", "5", "2")], "FID_SW CIRCUITO TIPO T_USUS_EQ_PROT CNT_VN_SW"),
        supports=frame([("A1", "10")], "FID_APOYO_FIN ALTURA"),
        causes=frame([("C1", "Viento")], "COD_CAUSA DESC_CAUSA"),
        transformers=frame([("T1", None, None, "25"), ("T2", "Chinchina", "9", "25")], "trafo_profile_id municipio CNT_USUS CAPACIDAD_NOMINAL"),
        weather=frame([("V1", "2024-01-05 10:00:00", "20,5")], "FID_VANO FECHA temp_0"),
        weather_columns=["temp_0"],
    )


def test_silver_fact_defaults(star):
    rows = {r["row_id"]: r for r in silver_fact(star).collect()}
    assert len(rows) == 3
    assert (rows[1]["circuit"], rows[1]["municipality"], rows[1]["equipment"], rows[1]["users"], rows[1]["temp_0"]) == ("CIR-1", "Manizales", "SW1", 40.0, "20,5")
    assert (rows[2]["circuit"], rows[2]["municipality"], rows[2]["equipment"], rows[2]["users"], rows[2]["span_impact"]) == ("Sin circuito", "Chinchina", "EQ1", 9.0, 1.5)
    assert (rows[3]["municipality"], rows[3]["cause"], rows[3]["day"], rows[3]["impact_flag"], rows[3]["municipality_confidence"]) == ("Sin municipio", None, None, 0, "unresolved")


def test_gold_tables_and_map(star):
    fact = silver_fact(star)
    gold = gold_tables(fact)
    daily = {r["circuit"]: r for r in gold["impact_daily"].where("day is not null").collect()}
    assert daily["CIR-1"]["metrics"]["UITI"] == 0.5 and daily["Sin circuito"]["event_count"] == 1
    tables = map_tables(fact, span_assets(star, "2024-03-01"))
    assert tables["map_points"].where("point_kind = 'asset'").count() == 3 and tables["map_segments"].count() == 3
    assert tables["map_points"].where("point_kind = 'asset'").first()["latitude"] == pytest.approx(5.05)
    bad = map_tables(fact, span_assets(star, "2024-03-01").withColumn("longitude", F.lit(999.0)))
    assert bad["map_points"].count() == 0 and bad["map_filter_index"].count() == 0


def test_dashboard_payload_is_bounded_and_stable(spark, star):
    rows = [("2024-01-05", f"C{i:03d}", "M", "F", float(i), 1, 0.0, 0.0) for i in range(75)]
    daily = spark.createDataFrame(rows, "d string, circuit string, municipality string, event_family string, uiti_total double, event_count long, duration_raw_total double, users_affected_total double")
    daily = daily.withColumns({"day": F.to_date("d"), "uiti_vano_total": F.col("uiti_total"), "first_event_ts": F.to_timestamp("d"), "last_event_ts": F.to_timestamp("d")})
    one, two = (json.loads(payloads.dashboard_context(month_view(daily), "2024-01", "M", c).first()["payload"]) for c in ("Todos", "Todos"))
    assert one == two and len(one["records"]) == 25 and one["records"][0]["circuit"] == "C074" and len(one["context_hash"]) == 16
    assert one["metrics"]["kpi_summary"]["event_count"] == 75
    none = json.loads(payloads.dashboard_context(month_view(daily), "1999-01", "M", None).first()["payload"])
    assert none["records"] == [] and none["metrics"]["kpi_summary"]["uiti_total"] == 0.0


def test_supports_hidden_when_circuits_are_chosen(spark):
    assets = spark.createDataFrame([("Supports", "c", "M", 1.0, 1.0), ("Switches", "c", "M", 1.0, 1.0)], "asset_family string, circuit string, municipality string, latitude double, longitude double")
    events = spark.createDataFrame([("2024-01-05", "2024-01", "c", "M", 1.0, 1.0)], "d string, period string, circuit string, municipality string, latitude double, longitude double").withColumn("day", F.to_date("d"))
    lines = assets.withColumns({"latitude_end": F.lit(2.0), "longitude_end": F.lit(2.0)})
    assert map_layers(assets, lines, events, "2024-01", "M", None)["assets"].count() == 2
    chosen = map_layers(assets, lines, events, "2024-01", "M", ["c"], day=6)
    assert chosen["assets"].count() == 1 and chosen["events"].count() == 0 and chosen["days"].first()["events"] == 1


def test_summary_of_empty_choice_and_empty_table(spark):
    from gridpulse.functions.metrics import METRIC_TOTALS
    from gridpulse.plans.interpret import summary

    names = ["circuit", "municipality", *METRIC_TOTALS.values()]
    kinds = "day date, circuit string, municipality string, " + ", ".join(f"{c} double" for c in METRIC_TOTALS.values())
    rows = spark.createDataFrame(
        [(d, "A", "m", *[1.0] * len(METRIC_TOTALS)) for d in ("2024-01-01", "2024-01-04")], ["day", *names]
    ).withColumn("day", F.col("day").cast("date"))
    daily = summary(rows, None, None, circuit="NOPE")["daily"].collect()
    assert len(daily) == 4 and all(r[k] == 0 for r in daily for k in METRIC_TOTALS)
    assert [r["UITI"] for r in summary(rows, None, None)["daily"].orderBy("day").collect()] == [1, 0, 0, 1]
    empty = spark.createDataFrame([], kinds)
    assert summary(empty, None, None)["daily"].count() == 0
    assert summary(empty, "2024-01-03", "2024-01-01")["daily"].count() == 3


def test_limits_are_arguments(spark):
    from gridpulse.operators.reshape import down_sample, hash_ordered_sample

    rows = spark.range(1001).withColumnRenamed("id", "k")
    assert down_sample(rows, ["k"], 1000).count() == 1000
    assert down_sample(rows, ["k"]).count() == hash_ordered_sample(rows, ["k"]).count() == 1001
    assert sorted(r["k"] for r in down_sample(rows, ["k"], 400).limit(3).collect()) == [0, 2, 4]


def test_month_and_key_filters_reach_the_scan(spark, tmp_path):
    from gridpulse.operators.filters import explorer_filter, period_mask

    path = str(tmp_path / "days")
    spark.range(90).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS day", "'m' AS municipality").write.parquet(path)
    frame = spark.read.parquet(path)
    for out, n in ((period_mask(frame, "2024-02", None, "day"), 29), (explorer_filter(frame, {}, "day", "2024-01-30", "2024-02-02"), 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(day" in plan and "LessThan(day" in plan and out.count() == n


def test_missing_columns_and_readiness(spark):
    from gridpulse.operators.quality import missing_columns

    assert list(missing_columns(["P_PARTKEY", " p_name", "p_weight"], ["p_partkey", "p_name"])) == ["p_weight"]
    spark.range(3).createOrReplaceTempView("ready_here")
    rows = {r["table"]: r["status"] for r in W.readiness(spark, ["ready_here", "not_here_at_all"]).collect()}
    assert rows == {"ready_here": "READY", "not_here_at_all": "MISSING"}


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_upsert_rewrites_only_the_partitions_it_meets(spark, tmp_path):
    from gridpulse.sources.writers import upsert_table

    path = tmp_path / "table"
    schema = "id long, part string, v string, updated_at long"
    rows = [(i, f"p{i % 5}", "old", 1) for i in range(50)] + [(None, "p0", "no key", 1), (100, "lonely", "old", 1)]
    spark.createDataFrame(rows, schema).write.partitionBy("part").parquet(str(path))
    before = _files(path)
    changes = [(1, "p1", "new", 2), (1, "p1", "newer", 3), (2, "p3", "moved", 2), (77, "p9", "added", 2), (None, "p0", "replaced", 2), (100, "p1", "left", 2)]
    met = upsert_table(spark, str(path), spark.createDataFrame(changes, schema), ["id"], ["part"])
    assert {r["part"] for r in met.collect()} == {"p0", "p1", "p2", "p3", "p9", "lonely"}
    want = {(i, p): v for i, p, v, _ in rows} | {(1, "p1"): "newer", (2, "p3"): "moved", (77, "p9"): "added", (None, "p0"): "replaced", (100, "p1"): "left"}
    want.pop((2, "p2")), want.pop((100, "lonely"))
    stored = spark.read.parquet(str(path)).collect()
    assert len(stored) == len(want) and {(r["id"], r["part"]): r["v"] for r in stored} == want
    after = _files(path)
    kept = {f: t for f, t in before.items() if f.startswith("part=p4")}
    assert kept and all(after[f] == t for f, t in kept.items()) and not any(f.startswith("part=lonely") for f in after)
    assert upsert_table(spark, str(path), spark.createDataFrame([], schema), ["id"], ["part"]).count() == 0 and _files(path) == after


def test_stored_gold_prunes_months(spark, tmp_path):
    from datetime import date, timedelta

    from gridpulse.operators.filters import in_window
    from gridpulse.plans.gold import load_gold, store_gold

    rows = [(date(2024, 1, 1) + timedelta(days=i), f"c{i % 3}", float(i)) for i in range(200)]
    daily = spark.createDataFrame(rows, "day date, circuit string, uiti_total double")
    store_gold({"impact_daily": daily, "plain": daily.drop("day")}, str(tmp_path))
    stored = load_gold(spark, str(tmp_path), "impact_daily", "plain")
    window = in_window(stored["impact_daily"], date(2024, 2, 10), date(2024, 3, 5))
    assert sorted(r["uiti_total"] for r in window.collect()) == [float(i) for i in range(40, 65)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in filters and "PushedFilters: [IsNotNull(day)" in plan
    assert len(window.inputFiles()) == len(stored["impact_daily"].inputFiles()) and "plain" in stored


def test_numeric_choice_reaches_the_scan(spark, tmp_path):
    from gridpulse.operators.filters import KIND_CHOICE, filter_predicates

    spark.range(10).write.parquet(str(tmp_path / "n"))
    frame = spark.read.parquet(str(tmp_path / "n"))
    out = frame.where(filter_predicates([[KIND_CHOICE, "id", "7", None]], frame.columns, frame.dtypes)[0])
    assert [r["id"] for r in out.collect()] == [7] and "EqualTo(id,7)" in out._jdf.queryExecution().executedPlan().toString()
    assert frame.where(filter_predicates([[KIND_CHOICE, "id", "seven", None]], frame.columns, frame.dtypes)[0]).count() == 0


def test_fact_tasks_follow_the_rows(spark, monkeypatch):
    """A task of the outage fact takes so many rows, whatever the number of shuffle partitions, and an event's rows stay together."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = SimpleNamespace(
        lineitem=frame(
            [(i // 2, i % 5, 1, i % 2, 1.0, 10.0 + i, 0.0, "A", "F", "1995-01-05") for i in range(60)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string",
        ).withColumn("l_shipdate", F.to_date("l_shipdate")),
        orders=frame([(i, i % 3, "1-URGENT", 5.0) for i in range(29)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").withColumn("o_orderdate", F.lit("1995-01-01").cast("timestamp")),
        customer=frame([(i, i) for i in range(3)], "c_custkey long, c_nationkey long"),
        nation=frame([(i, f"N{i}", 0) for i in range(3)], "n_nationkey long, n_name string, n_regionkey long"),
        region=frame([(0, "R")], "r_regionkey long, r_name string"),
        part=frame([(i, f"B{i}", "T") for i in range(5)], "p_partkey long, p_brand string, p_type string"),
    )
    t.spread = lambda name, *columns: getattr(t, name).select(*columns)
    plain = sorted(map(str, registry.fact(t).collect()))
    monkeypatch.setattr(registry, "TASK_ROWS", 5)
    rows = registry.fact(t).withColumn("task", F.spark_partition_id())
    assert rows.select("event_id", "task").distinct().count() == 30
    assert rows.select("task").distinct().count() > 4
    assert sorted(map(str, rows.drop("task").collect())) == plain


def test_readings_join_before_the_wide_dimensions(star, monkeypatch):
    """Rows are shuffled by span and time while they are narrow; columns keep the order of the dimensions."""
    from gridpulse.plans import gold

    joined = []
    monkeypatch.setattr(gold, "star_join", lambda fact, dims: (joined.extend(tuple(d.on) for d in dims), J.star_join(fact, dims))[1])
    out = silver_fact(star)
    assert joined.index(("span_id", "event_ts")) < joined.index(("span_id",))
    assert out.columns.index("temp_0") > out.columns.index("transformer_capacity")
    assert {r["span_id"]: r["temp_0"] for r in out.collect()} == {"V1": "20,5", "V2": None, "V3": None}


def test_digests_of_files_larger_than_a_task_may_read(spark, tmp_path):
    """Files past binaryFile's limit and a task's turn, whatever their bytes; what the text reader alters is read whole."""
    rng = random.Random(5)
    files = {
        "ends.bin": rng.randbytes(40_000) + b"\n",
        "open.bin": rng.randbytes(40_000) + b"x",
        "lines.txt": b"\r\n\n\r" * 9_000,
        "one line.txt": b"a" * 30_000,
        "named [1]{2}.bin": rng.randbytes(5_001) + b"\n\n",
        "same": b"\n" * 10_000,
        "exact": b"\n" * 5_000,
        "small": b"small\n",
        "sub/ends.bin": rng.randbytes(20_000) + b"\xff\n",
    }
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}

    def got(**options):
        rows = R.file_inventory(spark, str(tmp_path), digest=True, turn=5_000, **options).collect()
        return {r["path"].split(f"{tmp_path.name}/")[1]: (r["bytes"], r["sha256"]) for r in rows}

    def plain():
        return {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")
        assert got() == plain()
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        more = {"mark.csv": b"\xef\xbb\xbf" + b"a;b\n" * 3_000, "packed.gz": gzip.compress(rng.randbytes(9_000))}
        for name, data in more.items():
            (tmp_path / name).write_bytes(data)
        files |= more
        assert got() == plain()
        assert got(pattern="*.csv") == {"mark.csv": plain()["mark.csv"]}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_without_openssl_a_file_is_one_chain_in_one_task(spark, tmp_path, monkeypatch):
    data = random.Random(6).randbytes(20_000)
    (tmp_path / "a.bin").write_bytes(data)
    monkeypatch.setattr(D, "openssl", lambda: None)
    row = R.file_inventory(spark, str(tmp_path), digest=True, turn=3_000).first()
    assert row["sha256"] == hashlib.sha256(data).hexdigest()
