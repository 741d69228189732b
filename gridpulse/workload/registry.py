"""Query registry and the table roles shared by the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Table (or some of its columns) cut into the splits that the session's split size gives."""
        frame = getattr(self, name)
        return frame.select(*columns) if columns else frame

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- roles: outage fact from the order tables


def places(t: Tables) -> DataFrame:
    """Customer to circuit (nation) and municipality (region)."""
    return (
        t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
        .join(t.nation, "n_nationkey", "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_custkey", F.col("n_name").alias("circuit"), F.col("r_name").alias("municipality"))
    )


TASK_ROWS = 500_000


def by_rows(frame: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """``frame`` dealt by ``keys`` into one task per ``TASK_ROWS`` rows of ``counted``, where these are more than the cores.

    Packed shuffle bytes say little about the memory that sorts and aggregates of a task take; a count of its rows does.
    Stored tables are counted by their footers.
    """
    tasks = -(-counted.count() // TASK_ROWS)
    return frame.repartition(tasks, *keys) if tasks > frame.sparkSession.sparkContext.defaultParallelism else frame


def fact(t: Tables) -> DataFrame:
    """Line items as span facts with event, place, equipment and impact columns."""
    columns = (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_returnflag l_linestatus l_shipdate"
    )
    lines = t.spread("lineitem", *columns.split()).select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_partkey").alias("span_id"),
        F.col("l_suppkey").alias("profile_id"),
        F.col("l_linenumber").alias("transformer_count"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("span_impact"),
        F.col("l_quantity").alias("users"),
        F.col("l_shipdate"),
        F.col("l_returnflag").alias("event_family"),
        F.col("l_linestatus").alias("element_type"),
    )
    # the place joins the events before they meet the lines, so the line items are shuffled by event only
    events = t.orders.join(places(t), "o_custkey", "left").select(
        F.col("o_orderkey").alias("event_id"),
        "circuit",
        "municipality",
        F.col("o_orderdate").alias("event_ts"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("cause"),
        F.col("o_totalprice").alias("event_impact"),
    )
    spans = t.part.select(
        F.col("p_partkey").alias("span_id"),
        F.col("p_brand").alias("equipment"),
        F.col("p_type").alias("equipment_type"),
        (F.lit(4.0) + F.floor(F.col("p_partkey") / 100) * 0.01).alias("latitude"),
        (F.lit(-76.0) + F.pmod("p_partkey", F.lit(100)) * 0.01).alias("longitude"),
    )
    # events come last: where both sides are large the result is left partitioned by event, which the roll-ups need
    return (
        by_rows(lines.join(spans, "span_id", "left"), t.lineitem, "event_id")
        .join(events, "event_id", "left")
        .withColumn("duration", F.datediff("l_shipdate", "day").cast("double"))
        .drop("l_shipdate")
    )


FACT = """
fact AS (
 SELECT l_orderkey AS event_id, l_partkey AS span_id, l_suppkey AS profile_id, l_linenumber AS transformer_count,
  round(l_extendedprice * (1 - l_discount), 4) AS span_impact, l_quantity AS users, l_returnflag AS event_family,
  l_linestatus AS element_type, o_orderdate AS event_ts, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS cause,
  o_totalprice AS event_impact, n_name AS circuit, r_name AS municipality, p_brand AS equipment, p_type AS equipment_type,
  4.0::DOUBLE + floor(p_partkey / 100.0::DOUBLE) * 0.01::DOUBLE AS latitude,
  -76.0::DOUBLE + (p_partkey % 100) * 0.01::DOUBLE AS longitude,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS duration
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN part ON l_partkey = p_partkey)"""

SILVER = FACT + """,
silver_events AS (
 SELECT event_id, day, event_ts, circuit, municipality, cause, event_family,
  sum(coalesce(span_impact, 0)) AS uiti_total, sum(coalesce(span_impact, 0)) AS uiti_vano_total,
  max(coalesce(event_impact, 0)) AS uiti_event_total, max(coalesce(duration, 0)) AS duration_raw,
  sum(coalesce(users, 0)) AS users_affected, max(coalesce(transformer_count, 0)) AS transformer_count,
  count(*) AS fact_row_count, min(equipment) AS equipment, min(equipment_type) AS equipment_type,
  min(element_type) AS element_type, avg(latitude) AS latitude, avg(longitude) AS longitude
 FROM fact GROUP BY ALL)"""

DAILY = SILVER + """,
daily AS (
 SELECT day, circuit, municipality, event_family, sum(uiti_total) AS uiti_total, sum(uiti_vano_total) AS uiti_vano_total,
  count(DISTINCT event_id) AS event_count, sum(duration_raw) AS duration_raw_total, sum(users_affected) AS users_affected_total,
  sum(transformer_count) AS transformer_count_total, min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts
 FROM silver_events GROUP BY ALL)"""

ATTRIBUTION = FACT + """,
attribution AS (
 SELECT day, circuit, municipality, cause, event_family, equipment, equipment_type, count(DISTINCT event_id) AS event_count,
  sum(coalesce(span_impact, 0)) AS uiti_total, sum(coalesce(span_impact, 0)) AS uiti_vano_total,
  sum(coalesce(duration, 0)) AS duration_raw_total, sum(coalesce(users, 0)) AS users_affected_total,
  min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts
 FROM fact GROUP BY ALL)"""


# ---------------------------------------------------------------- roles: daily series from the event stream


def stream(t: Tables) -> DataFrame:
    """Events with day, series name and metric columns."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t.events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("circuit"), F.to_date("ts").alias("day"), "value", k.alias("k")
    )


def stream_daily(t: Tables) -> DataFrame:
    """Daily totals per series under the metric keys."""
    return stream(t).groupBy("circuit", "day").agg(
        F.round(F.sum("value"), 4).alias("UITI"),
        F.round(F.sum("k"), 4).alias("UITI_VANO"),
        F.count(F.lit(1)).cast("double").alias("EVENT_COUNT"),
        F.round(F.max("value"), 4).alias("USERS"),
        F.round(F.sum(F.col("value") * F.col("k")), 4).alias("DURATION_RAW"),
    )


STREAM = """
stream AS (SELECT event_id, ts, user_id, event_type AS circuit, CAST(ts AS DATE) AS day, value,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
raw_daily AS (SELECT circuit, day, round(sum(value), 4) AS UITI, round(sum(k), 4) AS UITI_VANO, CAST(count(*) AS DOUBLE) AS EVENT_COUNT,
  round(max(value), 4) AS USERS, round(sum(value * k), 4) AS DURATION_RAW FROM stream GROUP BY ALL),
span AS (SELECT circuit, min(day) AS d0, max(day) AS d1 FROM raw_daily GROUP BY circuit),
series AS (SELECT c.circuit, c.day, coalesce(UITI, 0) AS UITI, coalesce(UITI_VANO, 0) AS UITI_VANO, coalesce(EVENT_COUNT, 0) AS EVENT_COUNT,
  coalesce(USERS, 0) AS USERS, coalesce(DURATION_RAW, 0) AS DURATION_RAW
  FROM (SELECT circuit, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span) c
  LEFT JOIN raw_daily USING (circuit, day))"""


def text_day(name: str = "day"):
    return F.col(name).cast("string").alias(name)


def r4(*names: str):
    return [F.round(F.col(n).cast("double"), 4).alias(n) for n in names]


def sql_r4(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 4) AS {n}" for n in names)
