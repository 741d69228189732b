"""Readers, writers and catalogue jobs over copies of the test tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gridpulse.functions.cleaning import normalize_types, trim_column_names
from gridpulse.operators.quality import profile
from gridpulse.session import ensure_checkpoint_dir
from gridpulse.sources import readers as R
from gridpulse.sources import writers as W
from gridpulse.workload.registry import query, stream


def scratch(spark, name: str) -> str:
    """New folder below the checkpoint folder of the session, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{os.urandom(6).hex()}"


@query("s01_read_source", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t):
    return R.read_source(t.spark, t.path("orders"), "parquet").select("o_orderkey", "o_orderpriority")


@query("s02_text_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS seg, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(t):
    path = scratch(t.spark, "csv")
    rows = t.customer.select(F.col("c_custkey").alias("\ufeffc_custkey "), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias(" seg"), "c_nationkey")
    rows.write.option("header", "true").option("emptyValue", "").csv(path)
    return R.read_text_csv(t.spark, path)


@query(
    "s03_merge_files",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
)
def _(t):
    base = scratch(t.spark, "merge")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    options = {"header": "true", "sep": ";"}
    rows.where("o_orderstatus <> 'P'").write.options(**options).csv(f"{base}/a1")
    rows.where("o_orderstatus <> 'F'").write.options(**options).csv(f"{base}/a2")
    rows.select("o_custkey", "o_orderkey").write.options(**options).csv(f"{base}/a3")
    return R.merge_files(t.spark, [f"{base}/a{i}" for i in (1, 2, 3)], drop=["o_orderstatus"]).frame


@query("s04_json_lines", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE length(trim(text)) > 0 AND lang <> 'es'")
def _(t):
    path = scratch(t.spark, "jsonl")
    good = F.to_json(F.struct("doc_id", "text"))
    t.documents.select(F.when(F.col("lang") == "es", F.concat(F.lit("{broken "), F.col("doc_id"))).otherwise(good).alias("value")).write.text(path)
    return R.read_json_lines(t.spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


@query("s05_nested_items", "SELECT event_type AS city, user_id AS lat, event_id, value FROM events")
def _(t):
    nested = t.events.select(F.col("event_type").alias("city_name"), F.col("user_id").alias("lat0"), F.array(F.struct("event_id", "value")).alias("data"))
    path = scratch(t.spark, "nested")
    nested.write.json(path)
    return R.explode_items(t.spark.read.json(path), {"city": "city_name", "lat": "lat0"})


@query("s06_trim_columns", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return trim_column_names(t.part.select(F.col("p_partkey").alias(" p_partkey"), F.col("p_brand").alias("p_brand ")))


@query(
    "s07_normalize_types",
    "SELECT CAST(event_id AS DOUBLE) AS event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS fecha, '{\"u\":' || user_id || '}' AS box, event_type AS raw FROM events",
)
def _(t):
    rows = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("fecha"),
        F.struct(F.col("user_id").alias("u")).alias("box"), F.encode("event_type", "UTF-8").alias("raw"),
    )
    return normalize_types(rows, ["FECHA"]).withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


@query("s08_provenance", "SELECT 'orders' AS source_logical_name, 'orders.parquet' AS source_file, count(*) AS n FROM orders")
def _(t):
    rows = R.with_provenance(t.orders, "orders", t.folder)
    return rows.groupBy("source_logical_name", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query("s09_overwrite_table", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def _(t):
    path = scratch(t.spark, "table")
    W.write_table(t.orders.select("o_orderkey", "o_orderstatus"), path)
    W.write_table(t.orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled")), path, records_per_file=5000)
    return t.spark.read.parquet(path)


@query("s10_append_table", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    path = scratch(t.spark, "append")
    W.write_table(t.orders.select("o_orderkey"), path)
    W.append_table(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), path)
    return t.spark.read.parquet(path)


@query(
    "s11_ingest_log",
    "SELECT 'lineitem' AS logical_name, count(*) AS row_count, 2 AS column_count, strftime(min(l_shipdate), '%Y-%m-%d') AS min_date, strftime(max(l_shipdate), '%Y-%m-%d') AS max_date FROM lineitem UNION ALL "
    "SELECT 'part', count(*), 6, NULL, NULL FROM part UNION ALL SELECT 'pairs', count(*), 3, strftime(least(min(o_orderdate), TIMESTAMP '1994-05-05'), '%Y-%m-%d'), strftime(greatest(max(o_orderdate), TIMESTAMP '1994-05-05'), '%Y-%m-%d') FROM orders",
)
def _(t):
    pairs = t.orders.select("o_orderkey", "o_orderdate", F.lit("1994-05-05").cast("date").alias("other"))
    out = R.ingest_log(
        {"lineitem": (t.lineitem.select("l_orderkey", "l_shipdate"), ["l_shipdate"]), "part": (t.part, []), "pairs": (pairs, ["o_orderdate", "other"])}
    )
    return out.select("logical_name", "row_count", "column_count", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("min_date", "max_date")])


@query("s12_file_inventory")
def _(t):
    files = R.file_inventory(t.spark, t.folder, "*.parquet")
    manifest = t.nation.select(F.concat("n_name", F.lit(".parquet")).alias("file_name")).unionByName(files.select("file_name"))
    return R.availability(manifest, files)


@query("s13_file_digest")
def _(t):
    return R.file_inventory(t.spark, t.folder, "*.parquet", digest=True).select("file_name", "bytes", "sha256")


def _manifest(t) -> str:
    """JSON manifest with one entry per brand of the part table."""
    path = scratch(t.spark, "manifest")
    entries = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("expected_rows"), F.array_sort(F.collect_set("p_type")).alias("required_columns"))
    one = entries.select(F.col("p_brand").alias("logical_name"), "required_columns", "expected_rows")
    one.agg(F.collect_list(F.struct("*")).alias("raw_sources")).coalesce(1).write.json(path)
    return path


@query(
    "s14_manifest_inventory",
    "SELECT p_brand AS logical_name, '[' || string_agg(DISTINCT '\"' || p_type || '\"', ',' ORDER BY '\"' || p_type || '\"') || ']' AS required_columns_json, count(*) AS expected_rows FROM part GROUP BY p_brand",
)
def _(t):
    return R.manifest_inventory(t.spark, _manifest(t)).select("logical_name", "required_columns_json", "expected_rows")


@query(
    "s15_write_set",
    "SELECT 'nation' AS \"table\", 'csv' AS format, count(*) AS \"rows\", '[\"n_nationkey\", \"n_name\", \"n_regionkey\"]' AS columns_json FROM nation UNION ALL SELECT 'orders', 'csv', count(*), '[\"o_orderkey\", \"o_custkey\"]' FROM orders",
)
def _(t):
    return W.write_set({"nation": t.nation, "orders": t.orders.select("o_orderkey", "o_custkey")}, scratch(t.spark, "set"), "csv")


@query(
    "s16_upsert",
    "WITH ch AS (SELECT o_orderkey AS k, 'new' AS state, o_totalprice AS updated_at FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey + 1000000000, 'added', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT') "
    "SELECT o_orderkey AS k, o_orderstatus AS state FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT k, state FROM ch",
)
def _(t):
    now = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"), F.lit(0.0).alias("updated_at"))
    changed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("state"), F.col("o_totalprice").alias("updated_at"))
    older = changed.withColumns({"state": F.lit("old"), "updated_at": F.col("updated_at") - 1})
    added = t.orders.where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") + 1000000000).alias("k"), F.lit("added").alias("state"), F.col("o_totalprice").alias("updated_at"))
    return W.upsert(now, changed.unionByName(older).unionByName(added), ["k"]).select("k", "state")


@query("s17_insert_missing", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    current = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return W.insert_missing(current, t.customer.select("c_custkey"), ["c_custkey"])


@query("s18_json_events", "SELECT conv_id, turn, '[\"' || role || '\",\"' || turn || '\"]' AS parts FROM conversations")
def _(t):
    path = scratch(t.spark, "events")
    rows = t.conversations.select("conv_id", "turn", F.array("role", F.col("turn").cast("string")).alias("parts"))
    W.append_table(W.json_events(rows), path)
    return t.spark.read.parquet(path)


@query("s19_add_columns", "SELECT p_partkey, CAST(NULL AS VARCHAR) AS note, p_brand FROM part")
def _(t):
    return R.with_columns_present(t.part.select("p_partkey", "p_brand"), {"note": "string", "p_brand": "int"}).select("p_partkey", "note", "p_brand")


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "s21_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_percent, count(DISTINCT {c}) AS distinct_count, CASE WHEN count(DISTINCT {c}) <= 10 THEN 1 ELSE 0 END AS few_values FROM p"
        for c, k in zip(_PROFILED, ("bigint", "bigint", "string", "string"), strict=True)
    ).join(["WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ", ""]),
)
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", "o_orderpriority")
    return profile(rows).withColumn("few_values", F.col("few_values").cast("int"))


@query("s22_project_columns", "SELECT user_id, max(value) FILTER (hour(ts) = 0) AS temp_0, max(value) FILTER (hour(ts) = 1) AS temp_1 FROM events GROUP BY user_id, CAST(ts AS DATE)")
def _(t):
    wide = stream(t).groupBy("user_id", "day").agg(*[F.max(F.when(F.hour("ts") == h, F.col("value"))).alias(f"temp_{h}") for h in range(3)])
    return R.project_columns(wide, ["user_id", "user_id", "absent"], ["temp", "rain"], [0, 1])
