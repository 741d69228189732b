"""Column cleaning and filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridpulse.functions import cleaning as C
from gridpulse.functions import codes as K
from gridpulse.functions import text as X
from gridpulse.functions.metrics import METRIC_KEYS, metric_key_column
from gridpulse.functions.projection import to_lon_lat
from gridpulse.operators import filters as L
from gridpulse.operators.documents import authority_level, search_by_tokens, source_uri
from gridpulse.workload.registry import DAILY, FACT, fact, query, r4, text_day


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_map(column: str, table: dict) -> str:
    """CASE with a fallback to the code itself."""
    arms = " ".join(f"WHEN {_sql_text(str(k))} THEN {_sql_text(str(v))}" for k, v in table.items())
    return f"coalesce(CASE CAST({column} AS VARCHAR) {arms} END, CAST({column} AS VARCHAR))"


RAW = """raw AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 5 = 1 THEN NULL ELSE '  ' || c_mktsegment || ' ' END AS seg,
 CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '.', ',') END AS bal,
 CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'C' || c_nationkey END AS code FROM customer)"""


def _raw(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.when(k % 5 == 0, "   ").when(k % 5 == 1, None).otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("seg"),
        F.when(k % 7 == 0, "n/a").otherwise(F.regexp_replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), "\\.", ",")).alias("bal"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("C"), F.col("c_nationkey"))).alias("code"),
    )


@query("p01_clean_text", f"WITH {RAW} SELECT c_custkey, nullif(trim(seg), '') AS seg, nullif(trim(code), '') AS code FROM raw")
def _(t):
    return _raw(t).select("c_custkey", C.clean_text("seg").alias("seg"), C.clean_text("code").alias("code"))


@query("p02_decimal_number", f"WITH {RAW} SELECT c_custkey, TRY_CAST(replace(nullif(trim(bal), ''), ',', '.') AS DOUBLE) AS bal, coalesce(TRY_CAST(replace(nullif(trim(bal), ''), ',', '.') AS DOUBLE), 0) AS bal_zero FROM raw")
def _(t):
    return _raw(t).select("c_custkey", C.decimal_number("bal").alias("bal"), C.decimal_number("bal", 0.0).alias("bal_zero"))


STAMPS = "s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' WHEN o_orderkey % 9 = 1 THEN ' ' ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw FROM orders)"


def _stamps(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.when(k % 9 == 0, "not a date").when(k % 9 == 1, " ").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("raw"),
    )


@query(
    "p03_time_parts",
    f"WITH {STAMPS}, p AS (SELECT o_orderkey, TRY_CAST(trim(raw) AS TIMESTAMP) AS ts FROM s) SELECT o_orderkey, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%Y-%m') AS period, CAST(day(ts) AS VARCHAR) AS day_of_month FROM p",
)
def _(t):
    out = C.with_time_parts(_stamps(t), "raw")
    return out.select("o_orderkey", text_day(), "period", F.col("day_of_month").cast("string").alias("day_of_month"))


@query(
    "p04_default_chain",
    f"WITH {RAW} SELECT c_custkey, coalesce(nullif(trim(seg), ''), nullif(trim(code), ''), 'Sin municipio') AS place, coalesce(TRY_CAST(replace(nullif(trim(bal), ''), ',', '.') AS DOUBLE), 0) AS users FROM raw",
)
def _(t):
    return _raw(t).select(
        "c_custkey", C.first_filled("seg", "code", default="Sin municipio").alias("place"), C.first_number(C.decimal_number("bal")).alias("users")
    )


@query("p05_resolve_alias", f"WITH {RAW} SELECT c_custkey, coalesce(seg, code, 'Sin dato') AS label FROM raw")
def _(t):
    rows = _raw(t).withColumnRenamed("seg", " Segment")
    return rows.select("c_custkey", C.resolve_alias(rows, ["circuito", "SEGMENT", "fparent", "Code"], "Sin dato").alias("label"))


@query("p06_flags", f"WITH {RAW}, n AS (SELECT c_custkey, TRY_CAST(replace(nullif(trim(bal), ''), ',', '.') AS DOUBLE) AS bal FROM raw) SELECT c_custkey, CASE WHEN coalesce(bal, 0) > 0 THEN 1 ELSE 0 END AS impact_flag FROM n")
def _(t):
    return _raw(t).select("c_custkey", C.positive_flag(C.decimal_number("bal")).alias("impact_flag"))


@query(
    "p07_metric_keys",
    "SELECT event_id, CASE WHEN upper(trim(event_type)) IN ('UITI', 'UITI_VANO', 'EVENT_COUNT', 'USERS', 'DURATION_RAW') THEN upper(trim(event_type)) ELSE 'UITI' END AS metric_key FROM events",
)
def _(t):
    return t.events.select("event_id", metric_key_column("event_type").alias("metric_key"))


@query(
    "p08_code_text",
    "SELECT p_partkey, " + _sql_map("p_size", K.CAUSES) + " AS cause, " + _sql_map("p_size % 16", K.PHASES) + " AS phases, "
    + _sql_map("p_size % 9", K.SWITCH_STATES) + " AS state, " + _sql_map("p_size % 12", K.SUBSTATIONS) + " AS substation, "
    + _sql_map("upper(left(p_name, 1))", K.POLE_MATERIALS) + " AS material FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey", K.code_text("p_size", K.CAUSES).alias("cause"), K.code_text(F.col("p_size") % 16, K.PHASES).alias("phases"),
        K.code_text(F.col("p_size") % 9, K.SWITCH_STATES).alias("state"), K.code_text(F.col("p_size") % 12, K.SUBSTATIONS).alias("substation"),
        K.code_text(F.upper(F.substring("p_name", 1, 1)), K.POLE_MATERIALS).alias("material"),
    )


@query(
    "p08_asset_codes",
    f"SELECT p_partkey, " + _sql_map(f"[{', '.join(_sql_text(k) for k in K.SWITCH_ASSEMBLIES)}][p_size % {len(K.SWITCH_ASSEMBLIES) + 2} + 1]", K.SWITCH_ASSEMBLIES)
    + " AS assembly, " + _sql_map("['S', 'N', 'X'][p_size % 3 + 1]", K.TRANSFORMER_OWNERS) + " AS owner FROM part",
)
def _(t):
    """Switch assemblies and transformer owners; a part without an assembly code has no text."""
    codes = F.array(*[F.lit(k) for k in K.SWITCH_ASSEMBLIES])
    owner = F.array(*[F.lit(k) for k in ("S", "N", "X")])
    size = F.col("p_size").cast("int")
    return t.part.select(
        "p_partkey", K.code_text(F.get(codes, size % (len(K.SWITCH_ASSEMBLIES) + 2)), K.SWITCH_ASSEMBLIES).alias("assembly"),
        K.code_text(F.get(owner, size % 3), K.TRANSFORMER_OWNERS).alias("owner"),
    )


COMPANY = ("Grid", "net", "c")
OWNERS = "o AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' GRID ' WHEN 1 THEN 'grid' WHEN 2 THEN NULL WHEN 3 THEN 'C' ELSE c_name END AS owner, CASE c_custkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN ' ' END AS declared FROM customer)"


@query(
    "p09_owner_class",
    f"WITH {OWNERS}, k AS (SELECT *, CASE WHEN lower(trim(coalesce(owner, ''))) IN ('grid', 'net', 'c') THEN 'C' ELSE 'P' END AS owner_class FROM o) SELECT c_custkey, owner_class, coalesce(nullif(trim(declared), ''), owner_class) AS owner_type FROM k",
)
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey",
        F.when(k % 6 == 0, " GRID ").when(k % 6 == 1, "grid").when(k % 6 == 2, None).when(k % 6 == 3, "C").otherwise(F.col("c_name")).alias("owner"),
        F.when(k % 4 == 0, "P").when(k % 4 == 1, " ").alias("declared"),
    )
    return rows.select("c_custkey", K.owner_class("owner", COMPANY).alias("owner_class"), K.owner_type("declared", "owner", COMPANY).alias("owner_type"))


@query(
    "p10_later_of",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(greatest(coalesce(CASE WHEN l_linenumber > 2 THEN l_shipdate END, TIMESTAMP '1900-01-01'), coalesce(CASE WHEN l_linenumber % 2 = 0 THEN o_orderdate END, TIMESTAMP '1900-01-01')) AS DATE) AS VARCHAR) AS updated "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    one, two = F.when(F.col("l_linenumber") > 2, F.col("l_shipdate")), F.when(F.col("l_linenumber") % 2 == 0, F.col("o_orderdate"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date(C.later_of(one, two)).cast("string").alias("updated"))


@query(
    "p11_timestamp_from_parts",
    "SELECT event_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE strftime(make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)), '%Y-%m-%d %H:%M:%S') END AS at FROM events",
)
def _(t):
    rows = t.events.select(
        "event_id", F.year("ts").alias("y"), F.when(F.col("user_id") % 13 == 0, 13).otherwise(F.month("ts")).alias("m"), F.dayofmonth("ts").alias("d"),
        F.hour("ts").alias("h"), F.minute("ts").alias("i"), F.second("ts").alias("s"),
    )
    return rows.select("event_id", F.date_format(C.timestamp_from_parts("y", "m", "d", "h", "i", "s"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("p12_hours_between", "SELECT l_orderkey, l_partkey, l_suppkey, date_diff('second', o_orderdate, l_shipdate) / 3600.0 AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", C.hours_between("o_orderdate", "l_shipdate").alias("hours"))


POLES = """p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'FICTICIO' WHEN 1 THEN 'PORTICO' WHEN 2 THEN 'FACHADA' ELSE 'N' || p_size END AS assembly,
 CASE WHEN p_partkey % 3 = 0 THEN 'F' WHEN p_partkey % 3 = 1 THEN 'G' END AS pole_class, CASE WHEN p_partkey % 4 > 0 THEN upper(left(p_name, 1)) END AS material,
 CASE WHEN p_partkey % 7 > 1 THEN CAST(p_size AS DOUBLE) END AS pole_length, CASE WHEN p_partkey % 6 = 0 THEN '1' END AS grounding,
 substr('ABCDEFG', p_size % 7 + 1, 1) AS primary_guy, CAST(p_size % 3 AS DOUBLE) AS secondary_guy, CASE WHEN p_partkey % 2 = 0 THEN 'P' END AS owner_type FROM part)"""


@query(
    "p13_pole_rules",
    f"WITH {POLES}, q AS (SELECT *, coalesce(CASE assembly WHEN 'FICTICIO' THEN 10.0 WHEN 'PORTICO' THEN 10.0 WHEN 'FACHADA' THEN 6.0 END, pole_length) AS m FROM p) "
    "SELECT p_partkey, CASE WHEN pole_class = 'F' AND material IS NULL THEN 'No aplica' ELSE " + _sql_map("material", K.POLE_MATERIALS) + " END AS material, "
    "CASE WHEN pole_class = 'F' AND material IS NULL THEN 'No aplica' WHEN pole_class = 'F' AND grounding IS NULL THEN '0' ELSE grounding END AS grounding, "
    "CASE WHEN pole_class = 'F' AND material IS NULL THEN 'No aplica' ELSE CAST(CAST(" + _sql_map("primary_guy", K.GUY_LETTERS) + " AS DOUBLE) + secondary_guy AS VARCHAR) END AS guys, "
    "CASE WHEN pole_class = 'F' AND m IS NULL THEN 'No aplica' ELSE CAST(CAST(m AS DOUBLE) AS VARCHAR) END AS pole_length, coalesce(owner_type, 'C') AS owner_type FROM q",
)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        "p_partkey",
        F.when(k % 5 == 0, "FICTICIO").when(k % 5 == 1, "PORTICO").when(k % 5 == 2, "FACHADA").otherwise(F.concat(F.lit("N"), size)).alias("assembly"),
        F.when(k % 3 == 0, "F").when(k % 3 == 1, "G").alias("pole_class"),
        F.when(k % 4 > 0, F.upper(F.substring("p_name", 1, 1))).alias("material"),
        F.when(k % 7 > 1, size.cast("double")).alias("pole_length"),
        F.when(k % 6 == 0, "1").alias("grounding"),
        F.substring(F.lit("ABCDEFG"), size % 7 + 1, F.lit(1)).alias("primary_guy"),
        (size % 3).cast("double").alias("secondary_guy"),
        F.when(k % 2 == 0, "P").alias("owner_type"),
    )
    return K.pole_attributes(rows).drop("assembly", "pole_class")


@query(
    "p14_cast_by_schema",
    f"WITH {RAW}, {STAMPS} SELECT o_orderkey, CAST(CAST(TRY_CAST(trim(raw) AS TIMESTAMP) AS DATE) AS VARCHAR) AS day FROM s",
)
def _(t):
    rows = _stamps(t).select("o_orderkey", F.trim("raw").alias("day"), F.lit("x").alias("spare"))
    return C.cast_by_schema(rows, {"o_orderkey": "bigint", "day": "date"}).select("o_orderkey", text_day())


@query("p15_drop_nulls", f"WITH {RAW} SELECT c_custkey, code, seg FROM raw WHERE seg IS NOT NULL")
def _(t):
    return C.drop_rows_with_null(_raw(t).select("c_custkey", "code", "seg"))


@query("p15_drop_null_columns", f"WITH {RAW} SELECT c_custkey, code, bal FROM raw")
def _(t):
    return C.drop_columns_with_null(_raw(t))


@query(
    "p16_labels",
    f"WITH {FACT} SELECT event_id, span_id, profile_id, transformer_count, concat_ws(' | ', CAST(event_id AS VARCHAR), cause, CAST(span_id AS VARCHAR)) AS label, concat_ws(' | ', CAST(event_id AS VARCHAR), circuit, 'UITI_VANO ' || printf('%.4f', span_impact)) AS popup FROM fact",
)
def _(t):
    return fact(t).select(
        "event_id", "span_id", "profile_id", "transformer_count", C.label_text("event_id", "cause", "span_id").alias("label"), C.impact_label("event_id", "circuit", "span_impact").alias("popup")
    )


@query("p17_segment_middle", "SELECT c_custkey, round((c_acctbal + c_nationkey) / 2.0, 4) AS middle FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(C.segment_middle("c_acctbal", "c_nationkey"), 4).alias("middle"))


@query(
    "p18_generated_id",
    f"WITH {RAW} SELECT c_custkey, coalesce(nullif(trim(code), ''), 'local-event-' || left(sha1('{{\"cause\":\"' || trim(coalesce(seg, '')) || '\",\"start\":\"' || c_custkey || '\"}}'), 16)) AS event_id FROM raw",
)
def _(t):
    return _raw(t).select("c_custkey", X.generated_id("code", "local-event", start="c_custkey", cause="seg").alias("event_id"))


@query(
    "p19_context_hash",
    f"WITH {RAW} SELECT c_custkey, left(sha256('view|' || coalesce(seg, '') || '|' || c_custkey || '|' || coalesce(bal, '')), 16) AS context_hash FROM raw",
)
def _(t):
    return _raw(t).select("c_custkey", X.short_hash(F.lit("view"), "seg", "c_custkey", "bal").alias("context_hash"))


def sql_plain(column: str) -> str:
    """SQL twin of the text normaliser."""
    return (
        f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({column}, '')), '{X.ACCENTED}', '{X.PLAIN}'), '\\p{{Mn}}+', '', 'g'), '[^a-z0-9_./:-]+', ' ', 'g'))"
    )


def sql_tokens(column: str) -> str:
    stops = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_filter(list_distinct(string_split({sql_plain(column)}, ' ')), lambda w: length(w) >= 3 AND NOT list_contains([{stops}], w))"


@query(
    "p20_tokens",
    f"SELECT doc_id, md5({sql_plain('text')}) AS plain_md5, len({sql_tokens('text')}) AS n_tokens, array_to_string(list_sort({sql_tokens('text')})[1:20], ' ') AS head FROM documents",
)
def _(t):
    words = X.tokens("text")
    return t.spread("documents").select(
        "doc_id", F.md5(X.plain_text("text")).alias("plain_md5"), F.size(words).cast("long").alias("n_tokens"),
        F.array_join(F.slice(F.sort_array(words), 1, 20), " ").alias("head"),
    )


URLS = "u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/Volumes/a/' || url WHEN 1 THEN 'dbfs:/x/' || url WHEN 2 THEN 'c/arbol_decision_recomendaciones/' || page_id || '/f.pdf' ELSE url END AS path, CASE page_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'xlsx' END AS kind FROM pages)"


@query(
    "p21_source_uri",
    f"WITH {URLS} SELECT page_id, CASE WHEN path LIKE '/Volumes/%' THEN path WHEN path LIKE 'dbfs:/%' THEN regexp_replace(path, '^dbfs:', '') WHEN path LIKE '%arbol_decision_recomendaciones/%' THEN '/docs/' || regexp_extract(path, 'arbol_decision_recomendaciones/(.*)$', 1) "
    "ELSE '/docs/' || regexp_extract(path, '[^/]+$', 0) END AS source_uri, CASE WHEN lower(coalesce(kind, '')) = 'pdf' THEN 'normative_or_technical_document' WHEN lower(coalesce(kind, '')) = 'xlsx' THEN 'metadata_workbook' ELSE 'technical_document' END AS authority_level FROM u",
)
def _(t):
    k = F.col("page_id")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("/Volumes/a/"), "url")).when(k % 4 == 1, F.concat(F.lit("dbfs:/x/"), "url"))
        .when(k % 4 == 2, F.concat(F.lit("c/arbol_decision_recomendaciones/"), k, F.lit("/f.pdf"))).otherwise(F.col("url"))
    )
    kind = F.when(k % 3 == 0, "PDF").when(k % 3 == 1, "xlsx")
    return t.pages.select("page_id", source_uri(path, "/docs").alias("source_uri"), authority_level(F.lower(F.coalesce(kind, F.lit("")))).alias("authority_level"))


def _projection_sql() -> str:
    """The same series written as SQL, from the constants of the projection."""
    from math import radians, sqrt

    from gridpulse.functions.projection import TransverseMercator

    crs = TransverseMercator()
    e = crs.ecc
    ep = e / (1 - e)
    e1 = (1 - sqrt(1 - e)) / (1 + sqrt(1 - e))
    a = crs.axis

    def d(v: float) -> str:
        return f"{v!r}::DOUBLE"

    return (
        f"WITH p AS (SELECT p_partkey, 800000::DOUBLE + (p_partkey * 379) % 400000 AS x, 900000::DOUBLE + (p_partkey * 541) % 300000 AS y FROM part), "
        f"m AS (SELECT *, ({d(crs.arc(radians(crs.latitude)))} + y - 1000000) / {d(a * (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256))} AS mu FROM p), "
        f"f AS (SELECT *, mu + {d(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu) + {d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu) + {d(151 * e1**3 / 96)} * sin(6 * mu) + {d(1097 * e1**4 / 512)} * sin(8 * mu) AS ph FROM m), "
        f"g AS (SELECT *, {d(ep)} * cos(ph) ** 2 AS c, tan(ph) ** 2 AS t, {d(a)} / sqrt(1 - {d(e)} * sin(ph) ** 2) AS n, {d(a * (1 - e))} / (1 - {d(e)} * sin(ph) ** 2) ** 1.5 AS r FROM f), "
        f"h AS (SELECT *, (x - 1000000) / n AS k FROM g) "
        f"SELECT p_partkey, round(degrees((k - (1 + 2*t + c) * k**3 / 6 + (5 - 2*c + 28*t - 3*c*c + {d(8 * ep)} + 24*t*t) * k**5 / 120) / cos(ph)) + {d(crs.longitude)}, 7) AS longitude, "
        f"round(degrees(ph - (n * tan(ph) / r) * (k**2 / 2 - (5 + 3*t + 10*c - 4*c*c - {d(9 * ep)}) * k**4 / 24 + (61 + 90*t + 298*c + 45*t*t - {d(252 * ep)} - 3*c*c) * k**6 / 720)), 7) AS latitude FROM h"
    )


@query("p23_projection", _projection_sql())
def _(t):
    x = F.lit(800_000.0) + F.pmod(F.col("p_partkey") * 379, F.lit(400_000))
    y = F.lit(900_000.0) + F.pmod(F.col("p_partkey") * 541, F.lit(300_000))
    lon, lat = to_lon_lat(x, y)
    return t.part.select("p_partkey", F.round(lon, 7).alias("longitude"), F.round(lat, 7).alias("latitude"))


@query("p25_row_text", f"WITH {RAW} SELECT c_custkey, concat_ws(' | ', 'c_custkey: ' || c_custkey, 'seg: ' || nullif(trim(seg), ''), 'code: ' || nullif(trim(code), '')) AS row_text FROM raw")
def _(t):
    rows = _raw(t).select("c_custkey", "seg", "code")
    return rows.select("c_custkey", C.row_as_text(rows).alias("row_text"))


@query(
    "p26_numeric_risk",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(greatest(0, least(1, (l_quantity + l_discount + l_tax + coalesce(CASE WHEN l_linenumber > 3 THEN l_linenumber END, 0)) / ((3 + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END) * 100.0))), 6) AS score, "
    "CASE WHEN greatest(0, least(1, (l_quantity + l_discount + l_tax + coalesce(CASE WHEN l_linenumber > 3 THEN l_linenumber END, 0)) / ((3 + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END) * 100.0))) >= 0.5 THEN 'high_risk' ELSE 'low_risk' END AS label FROM lineitem",
)
def _(t):
    rows = t.lineitem.withColumn("late", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("double")))
    score, label = C.numeric_risk(["l_quantity", "l_discount", "l_tax", "late"])
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(score, 6).alias("score"), label.alias("label"))


# ---------------------------------------------------------------- filters


@query(
    "f01_window",
    f"WITH {FACT}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM fact) SELECT count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM fact, b WHERE day BETWEEN greatest(lo, hi - 179) AND hi",
)
def _(t):
    days = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey")
    low, high = L.date_bounds(t.orders, "o_orderdate")
    first, last = L.coerce_window(None, None, low, high)
    return L.in_window(days, first, last).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day")
    )


@query("f02_circuits", f"WITH {FACT} SELECT circuit, count(*) AS n FROM fact WHERE circuit IN ('NATION_1', 'NATION_7') GROUP BY circuit")
def _(t):
    return L.choose_circuits(fact(t), [" NATION_1", "NATION_7", "NATION_1 ", ""]).groupBy("circuit").agg(F.count(F.lit(1)).alias("n"))


FILTERS = [
    ["seleccion", "cause", "5-LOW", None],
    ["rango_num", "span_impact", ">=", 20000],
    ["rango_num", "span_impact", "like", 3],
    ["fecha", "day", "1999-12-31", "1996-01-01"],
    ["seleccion", "no_such_column", "x", None],
    ["rango_num", "users", "<", None],
]


@query(
    "f03_typed_filters",
    f"WITH {FACT} SELECT event_id, span_id, profile_id, round(span_impact, 4) AS span_impact FROM fact WHERE cause = '5-LOW' AND span_impact >= 20000 AND day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def _(t):
    return L.apply_filters(fact(t), FILTERS).select("event_id", "span_id", "profile_id", F.round("span_impact", 4).alias("span_impact"))


@query(
    "f04_condition_text",
    f"WITH {FACT} SELECT 'P(UITI | Eventos Vano, cause = 5-LOW, span_impact >= 20000, span_impact like 3, day 1999-12-31 - 1996-01-01, no_such_column = x)' AS wording, count(*) AS n FROM fact WHERE cause = '5-LOW' AND span_impact >= 20000 AND day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def _(t):
    rows = L.apply_filters(fact(t), FILTERS).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.lit(L.condition_text("UITI", "Eventos Vano", FILTERS)).alias("wording"), "n")


ELIGIBLE = "e AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'NP' ELSE 'P' END AS cause_type, CASE p_partkey % 5 WHEN 0 THEN '13.2' WHEN 1 THEN '33' WHEN 2 THEN 'TFD' WHEN 3 THEN 'TFP' ELSE '115' END AS element, " + _sql_map("p_size", K.CAUSES) + " AS cause, p_retailprice / 10 AS hours FROM part)"


@query(
    "f05_eligible_events",
    f"WITH {ELIGIBLE} SELECT p_partkey FROM e WHERE ((cause_type = 'NP' AND element IN ('13.2', '33')) OR element IN ('TFD', 'TFP')) AND cause NOT IN ({', '.join(_sql_text(c) for c in K.EXCLUDED_CAUSES)}) AND hours <= 120",
)
def _(t):
    k = F.col("p_partkey")
    element = F.when(k % 5 == 0, "13.2").when(k % 5 == 1, "33").when(k % 5 == 2, "TFD").when(k % 5 == 3, "TFP").otherwise("115")
    test = K.eligible_event(F.when(k % 2 == 0, "NP").otherwise("P"), element, K.code_text("p_size", K.CAUSES), F.col("p_retailprice") / 10)
    return t.part.where(test).select("p_partkey")


@query("f06_voltages", "SELECT p_partkey FROM part WHERE CASE p_size % 5 WHEN 0 THEN 13.2 WHEN 1 THEN 33 WHEN 2 THEN 7.62 WHEN 3 THEN 115 ELSE 230 END IN (7.6, 7.62, 7.621, 13.2, 33)")
def _(t):
    k = F.col("p_size") % 5
    kv = F.when(k == 0, 13.2).when(k == 1, 33.0).when(k == 2, 7.62).when(k == 3, 115.0).otherwise(230.0)
    return t.part.where(K.voltage_kept(kv)).select("p_partkey")


@query(
    "f07_explorer_filter",
    "SELECT o_orderkey FROM orders WHERE trim(o_orderstatus) = 'F' AND CAST(o_orderdate AS DATE) >= DATE '1996-06-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-01'",
)
def _(t):
    rows = L.explorer_filter(t.orders, {"o_orderstatus": " F ", "o_orderpriority": "Todos", "absent": "x"}, "o_orderdate", "1996-06-01", "1997-06-01")
    return rows.select("o_orderkey")


@query(
    "f08_coordinate_gate",
    "SELECT count(*) AS total, count(*) FILTER (l_extendedprice / 500 - 180 BETWEEN -180 AND 180 AND l_quantity * 2 BETWEEN -90 AND 90) AS valid, "
    "CASE WHEN count(*) FILTER (l_extendedprice / 500 - 180 BETWEEN -180 AND 180 AND l_quantity * 2 BETWEEN -90 AND 90) / count(*) >= 0.95 THEN 'ok' ELSE 'empty' END AS verdict FROM lineitem",
)
def _(t):
    rows = t.lineitem.select((F.col("l_extendedprice") / 500 - 180).alias("lon"), (F.col("l_quantity") * 2).alias("lat"))
    return L.lon_lat_share(rows, ["lon"], ["lat"]).select("total", "valid", F.when(F.col("lon_lat_ok"), "ok").otherwise("empty").alias("verdict"))


@query("f09_period_mask", f"WITH {FACT} SELECT event_id, span_id, profile_id FROM fact WHERE strftime(day, '%Y-%m') = '1997-03' AND municipality = 'ASIA'")
def _(t):
    return L.period_mask(fact(t), "1997-03", " ASIA ", "day").select("event_id", "span_id", "profile_id")


@query(
    "f10_token_search",
    f"SELECT p_partkey FROM part WHERE len(list_intersect({sql_tokens('p_name')}, ['red', 'bolt'])) > 0",
)
def _(t):
    return search_by_tokens(t.part, ["p_name"], "¿Réd o bolt?").select("p_partkey")


@query("f11_only_days", "SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING max(value) > 250)")
def _(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("day"), "value")
    chosen = rows.groupBy("day").agg(F.max("value").alias("peak")).where("peak > 250")
    return L.only_days(rows, chosen, ["day"]).select("event_id")


@query("f12_comma_list", f"WITH {FACT} SELECT circuit, count(*) AS n FROM fact WHERE circuit IN ('NATION_2', 'NATION_9') GROUP BY circuit")
def _(t):
    return fact(t).where(L.comma_list_predicate("NATION_2, NATION_9", "circuit")).groupBy("circuit").agg(F.count(F.lit(1)).alias("n"))


@query("f13_name_exclusion", "SELECT page_id FROM pages WHERE NOT (contains(lower(url), 'example.com') OR contains(lower(url), '/en/') OR contains(lower(url), 'borrar'))")
def _(t):
    return t.pages.where(~X.name_excluded("url", ["Example.com", "/en/", "borrar"])).select("page_id")


@query("f14_usable_variables", "SELECT p_partkey, p_name AS variable FROM part WHERE NOT regexp_matches(lower(trim(p_name)), 'id|fecha|date|uiti|saidi|saifi|target|outcome|causa') AND length(trim(p_name)) > 0")
def _(t):
    return L.usable_variables(t.part.select("p_partkey", F.col("p_name").alias("variable")))
