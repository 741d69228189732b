"""Joins, spatial and network operators, key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import joins as J
from gridpulse.operators import quality as Q
from gridpulse.operators import reshape as R
from gridpulse.operators import spatial as X
from gridpulse.operators.patterns import rule_matches
from gridpulse.workload.registry import FACT, fact, places, query, r4, text_day


@query(
    "j01_star_join",
    f"WITH {FACT} SELECT event_id, span_id, profile_id, transformer_count, CAST(day AS VARCHAR) AS day, circuit, municipality, cause, equipment, round(span_impact, 4) AS span_impact, duration FROM fact",
)
def _(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("span_id"), F.col("l_suppkey").alias("profile_id"),
        F.col("l_linenumber").alias("transformer_count"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("span_impact"), "l_shipdate",
    )
    events = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("cause")
    )
    wide = J.star_join(
        lines,
        [
            J.Dimension(events, {"event_id": "o_orderkey"}, ["customer", "day", "cause"]),
            J.Dimension(places(t), {"customer": "o_custkey"}, ["circuit", "municipality"]),
            J.Dimension(t.part.withColumnRenamed("p_brand", "equipment"), {"span_id": "p_partkey"}, ["equipment"]),
        ],
    )
    return wide.select(
        "event_id", "span_id", "profile_id", "transformer_count", text_day(), "circuit", "municipality", "cause", "equipment", "span_impact",
        F.datediff("l_shipdate", "day").cast("double").alias("duration"),
    )


@query(
    "j02_two_key_join",
    "WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS peak FROM events GROUP BY ALL) "
    "SELECT event_id, e.user_id, peak FROM events e LEFT JOIN w ON e.user_id = w.user_id AND CAST(e.ts AS DATE) = w.day",
)
def _(t):
    rows = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    peaks = rows.groupBy("user_id", "day").agg(F.max("value").alias("peak"))
    return J.star_join(rows.drop("value"), [J.Dimension(peaks, {"user_id": "user_id", "day": "day"}, ["peak"])]).drop("day")


@query("j03_validated_join", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    side = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.validated_join(t.orders.select("o_orderkey", "o_custkey"), side, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("j04_missing_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return J.missing_keys(t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'"), {"c_custkey": "o_custkey"})


SNAP = f"""WITH {FACT}, ev AS (SELECT event_id, span_id, profile_id, transformer_count, day, CASE transformer_count % 3 WHEN 0 THEN 'interruptor' WHEN 1 THEN 'transformador' ELSE 'otro' END AS kind,
 CAST(CASE transformer_count % 3 WHEN 0 THEN span_id ELSE profile_id END AS VARCHAR) AS code, span_impact FROM fact),
snap AS (SELECT 'interruptor' AS kind, CAST(l_partkey AS VARCHAR) AS code, date_trunc('month', l_shipdate) AS m, max(l_tax) AS phases, NULL AS kva FROM lineitem GROUP BY ALL
 UNION ALL SELECT 'transformador', CAST(l_suppkey AS VARCHAR), date_trunc('month', l_shipdate), NULL, max(l_quantity) FROM lineitem GROUP BY ALL)
"""


def _snapshot_inputs(t):
    rows = fact(t).select("event_id", "span_id", "profile_id", "transformer_count", "day", "span_impact")
    kind = F.when(F.col("transformer_count") % 3 == 0, "interruptor").when(F.col("transformer_count") % 3 == 1, "transformador").otherwise("otro")
    rows = rows.withColumns(
        {"equipment_type": kind, "equipment": F.when(F.col("transformer_count") % 3 == 0, F.col("span_id")).otherwise(F.col("profile_id")).cast("string")}
    )
    month = F.trunc("l_shipdate", "MM").alias("month")
    switches = t.lineitem.groupBy(F.col("l_partkey").alias("code"), month).agg(F.max("l_tax").alias("phases"))
    transformers = t.lineitem.groupBy(F.col("l_suppkey").alias("code"), month).agg(F.max("l_quantity").alias("kva"))
    layers = [
        J.SnapshotLayer("interruptor", switches, "code", "month", {"phases": "phases"}),
        J.SnapshotLayer("transformador", transformers, "code", "month", {"kva": "kva"}),
    ]
    return rows, layers


_SNAP_COLS = "event_id, span_id, profile_id, transformer_count, ev.kind AS equipment_type, phases, kva, round(span_impact, 4) AS span_impact"


@query(
    "j05_snapshot_join",
    SNAP + f"SELECT {_SNAP_COLS} FROM ev LEFT JOIN snap ON ev.kind = snap.kind AND ev.code = snap.code AND date_trunc('month', ev.day) = snap.m WHERE snap.kind IS NOT NULL OR ev.kind = 'otro'",
)
def _(t):
    rows, layers = _snapshot_inputs(t)
    out = J.snapshot_join(rows, layers, ts="day")
    return out.select("event_id", "span_id", "profile_id", "transformer_count", "equipment_type", "phases", "kva", F.round("span_impact", 4).alias("span_impact"))


@query(
    "j06_snapshot_inner",
    SNAP + f"SELECT {_SNAP_COLS} FROM ev JOIN snap ON ev.kind = snap.kind AND ev.code = snap.code AND date_trunc('month', ev.day) = snap.m WHERE day >= DATE '1997-01-01' AND phases > 0.05",
)
def _(t):
    rows, layers = _snapshot_inputs(t)
    out = J.snapshot_join(rows.where("day >= date'1997-01-01'"), layers[:1], ts="day", how="inner").where("phases > 0.05")
    return out.withColumn("kva", F.lit(None).cast("double")).select(
        "event_id", "span_id", "profile_id", "transformer_count", "equipment_type", "phases", "kva", F.round("span_impact", 4).alias("span_impact")
    )


@query("j07_split_by_type", SNAP + "SELECT event_id, code AS equipment, span_id FROM ev WHERE kind = 'interruptor'")
def _(t):
    rows, _layers = _snapshot_inputs(t)
    parts = J.split_by_type(
        rows, {"interruptor": ["event_id", "equipment", "span_id", "event_id"], "otro": ["event_id"]}, "equipment_type"
    )
    return parts["interruptor"]


@query(
    "j08_two_hop_lookup",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, n_name, "
    "CASE WHEN n_name IS NOT NULL THEN 'nation:key' END AS n_name_source, CASE WHEN n_name IS NOT NULL THEN 'direct_code' ELSE 'unresolved' END AS n_name_confidence "
    "FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
)
def _(t):
    return J.two_hop_lookup(
        t.orders, t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"),
        t.nation.where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey"),
        "o_orderkey", "o_custkey", "c_nationkey", "n_name", "nation:key",
    )


POINTS = """pts AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009) * 0.01::DOUBLE AS x, ((c_custkey * 53) % 997) * 0.01::DOUBLE AS y FROM customer),
refs AS (SELECT n_name AS label, ((n_nationkey * 211) % 1009) * 0.01::DOUBLE AS rx, ((n_nationkey * 173) % 997) * 0.01::DOUBLE AS ry FROM nation)"""


def _points(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 37, F.lit(1009)) * 0.01).alias("x"), (F.pmod(F.col("c_custkey") * 53, F.lit(997)) * 0.01).alias("y")
    )


@query(
    "j09_nearest_reference",
    f"WITH {POINTS} SELECT id, arg_min(label, (x - rx) ** 2 + (y - ry) ** 2) AS label, round(sqrt(min((x - rx) ** 2 + (y - ry) ** 2)), 4) AS distance FROM pts, refs GROUP BY id",
)
def _(t):
    refs = t.nation.select(
        F.col("n_name").alias("label"), (F.pmod(F.col("n_nationkey") * 211, F.lit(1009)) * 0.01).alias("ref_x"), (F.pmod(F.col("n_nationkey") * 173, F.lit(997)) * 0.01).alias("ref_y")
    )
    return X.nearest_reference(_points(t), refs, "x", "y", "label").select("id", "label", F.round("distance", 4).alias("distance"))


SEGMENTS = """seg AS (SELECT p_partkey AS sid, ((p_partkey * 41) % 1009) * 0.01::DOUBLE AS x1, ((p_partkey * 59) % 997) * 0.01::DOUBLE AS y1,
 ((p_partkey * 41) % 1009) * 0.01::DOUBLE + (p_size % 5) * 0.03::DOUBLE AS x2, ((p_partkey * 59) % 997) * 0.01::DOUBLE + (p_size % 3) * 0.04::DOUBLE AS y2 FROM part)"""


def _segments(t):
    x, y = F.pmod(F.col("p_partkey") * 41, F.lit(1009)) * 0.01, F.pmod(F.col("p_partkey") * 59, F.lit(997)) * 0.01
    return t.part.select(
        F.col("p_partkey").alias("sid"), x.alias("x1"), y.alias("y1"), (x + F.col("p_size") % 5 * 0.03).alias("x2"), (y + F.col("p_size") % 3 * 0.04).alias("y2")
    )


@query(
    "j10_points_near_segments",
    f"WITH {POINTS}, {SEGMENTS}, d AS (SELECT sid, id, CASE WHEN (x2-x1)**2 + (y2-y1)**2 = 0 THEN 0 ELSE greatest(0, least(1, ((x-x1)*(x2-x1) + (y-y1)*(y2-y1)) / ((x2-x1)**2 + (y2-y1)**2))) END AS f, x, y, x1, y1, x2, y2 "
    "FROM pts JOIN seg ON x BETWEEN least(x1,x2) - 0.06 AND greatest(x1,x2) + 0.06 AND y BETWEEN least(y1,y2) - 0.06 AND greatest(y1,y2) + 0.06), "
    "e AS (SELECT sid, id, sqrt((x - (x1 + f*(x2-x1)))**2 + (y - (y1 + f*(y2-y1)))**2) AS dist FROM d) SELECT sid AS segment_id, id AS point_id, round(dist, 4) AS distance FROM e WHERE dist < 0.0523",
)
def _(t):
    near = X.points_near_segments(
        _points(t), _segments(t), {"id": "id", "x": "x", "y": "y"}, {"id": "sid", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, radius=0.0523, cell=0.2
    )
    return near.withColumn("distance", F.round("distance", 4))


EDGES = """edges AS (SELECT p_partkey // 2 AS src, p_partkey AS dst, 'S' || p_partkey AS code FROM part WHERE p_partkey > 0
 UNION ALL SELECT p_size AS src, p_partkey AS dst, 'X' || p_partkey AS code FROM part WHERE p_partkey > p_size * 7)"""


def _edges(t):
    """Tree of parts plus one cross link each; every second segment is drawn against the flow."""
    tree = t.part.where("p_partkey > 0").select(
        F.floor(F.col("p_partkey") / 2).alias("up"), F.col("p_partkey").alias("down"), F.concat(F.lit("S"), F.col("p_partkey")).alias("code")
    )
    cross = t.part.where("p_partkey > p_size * 7").select(
        F.col("p_size").cast("long").alias("up"), F.col("p_partkey").alias("down"), F.concat(F.lit("X"), F.col("p_partkey")).alias("code")
    )
    flipped = F.col("down") % 2 == 0
    drawn = tree.unionByName(cross).select(
        F.when(flipped, F.col("down")).otherwise(F.col("up")).alias("a"), F.when(flipped, F.col("up")).otherwise(F.col("down")).alias("b"),
        F.when(flipped, 2).otherwise(1).alias("order"), "code",
    )
    return X.directed_edges(drawn, "a", "b", "order", "code")


REACH = f"WITH RECURSIVE {EDGES}, r(source, node) AS (SELECT DISTINCT n_nationkey + 1, CAST(n_nationkey + 1 AS BIGINT) FROM nation UNION SELECT source, dst FROM r JOIN edges ON node = src)"


def _reached(t):
    sources = t.nation.select((F.col("n_nationkey") + 1).cast("long").alias("source"))
    return X.downstream(_edges(t), sources)


@query("j11_downstream", REACH + " SELECT CAST(source AS BIGINT) AS source, node FROM r")
def _(t):
    return _reached(t)


@query(
    "j12_downstream_segments",
    REACH + " SELECT DISTINCT CAST(a.source AS BIGINT) AS source, code FROM edges JOIN r a ON a.node = src JOIN r b ON b.source = a.source AND b.node = dst",
)
def _(t):
    return X.downstream_segments(_reached(t), _edges(t))


BRIDGE = """nodes AS (SELECT DISTINCT l_partkey AS asset, l_suppkey AS node, date_trunc('month', l_shipdate) AS m FROM lineitem),
ends AS (SELECT DISTINCT unnest([s_suppkey, (s_suppkey * 7) % 64]) AS node, date_trunc('month', o_orderdate) AS m FROM orders JOIN supplier ON o_custkey = s_suppkey),
assets AS (SELECT DISTINCT l_partkey AS asset, l_returnflag AS flag, date_trunc('month', l_shipdate) AS m FROM lineitem)"""


@query(
    "j13_node_bridge",
    f"WITH {BRIDGE} SELECT DISTINCT s.asset, flag, CAST(CAST(s.m AS DATE) AS VARCHAR) AS month FROM assets s JOIN nodes n ON s.asset = n.asset AND s.m = n.m SEMI JOIN ends e ON e.m = n.m AND e.node = n.node",
)
def _(t):
    month = F.trunc("l_shipdate", "MM").alias("month")
    nodes = t.lineitem.select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("node"), month)
    edges = t.orders.join(t.supplier, F.col("o_custkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 64).alias("b"), F.trunc("o_orderdate", "MM").alias("month")
    )
    assets = t.lineitem.select(F.col("l_partkey").alias("asset"), F.col("l_returnflag").alias("flag"), month).distinct()
    return J.node_bridge(assets, nodes, edges, "asset", "node", "month", "a", "b").withColumn("month", F.col("month").cast("string"))


_H = [f"h{h}-value" for h in range(24)]


@query(
    "j14_lookback_hours",
    "WITH ev AS (SELECT event_id, user_id, date_trunc('day', ts - INTERVAL 24 HOURS) AS o FROM events), "
    "hr AS (SELECT user_id, date_trunc('hour', ts) AS h, max(value) AS value FROM events GROUP BY ALL) SELECT event_id, ev.user_id, "
    + ", ".join(f"max(value) FILTER (date_diff('hour', o, h) = {i}) AS \"h{i}-value\"" for i in range(24))
    + " FROM ev LEFT JOIN hr ON ev.user_id = hr.user_id AND h >= o AND h < o + INTERVAL 24 HOURS GROUP BY event_id, ev.user_id",
)
def _(t):
    events = t.events.select("event_id", "user_id", "ts")
    hourly = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("at")).agg(F.max("value").alias("value"))
    return J.lookback_hours(events, hourly, "user_id", "event_id", "ts", "at", ["value"]).select("event_id", "user_id", *_H)


@query(
    "j15_first_match",
    "SELECT o_orderkey, coalesce(s_acctbal, p_retailprice) AS place FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey LEFT JOIN part ON o_custkey = p_partkey",
)
def _(t):
    left = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("place"))
    right = t.part.select("p_partkey", F.col("p_retailprice").alias("place"))
    return J.first_match(t.orders.select("o_orderkey", "o_custkey"), [(left, "s_suppkey"), (right, "p_partkey")], "o_custkey", ["place"]).drop("o_custkey")


def _rules(t):
    return t.spark.createDataFrame(
        [
            ("r1", 0.85, ["red*", "*ring"], ["blue ?*"]),
            ("r2", 0.9, ["*widget"], ["small*"]),
            ("r3", 1.0, ["nothing*"], ["none"]),
            ("r4", 0.8, ["RED WIDGET"], ["large bolt"]),
        ],
        "rule_id string, weight double, origin array<string>, destination array<string>",
    )


@query(
    "j16_wildcard_rules",
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part), r(rule_id, w, side, re) AS (VALUES ('r1', 0.85::DOUBLE, 'o', '^RED.*$'), ('r1', 0.85, 'o', '^.*RING$'), ('r1', 0.85, 'd', '^BLUE ..*$'), "
    "('r2', 0.9, 'o', '^.*WIDGET$'), ('r2', 0.9, 'd', '^SMALL.*$'), ('r3', 1.0, 'o', '^NOTHING.*$'), ('r3', 1.0, 'd', '^NONE$'), ('r4', 0.8, 'o', '^RED WIDGET$'), ('r4', 0.8, 'd', '^LARGE BOLT$')), "
    "h AS (SELECT DISTINCT rule_id, w, side, name FROM r JOIN n ON regexp_matches(upper(name), re)) SELECT rule_id, w AS match_strength, "
    "coalesce(string_agg(name, ',' ORDER BY name) FILTER (side = 'o'), '') AS origins, coalesce(string_agg(name, ',' ORDER BY name) FILTER (side = 'd'), '') AS destinations FROM h GROUP BY rule_id, w",
)
def _(t):
    out = J.wildcard_rules(_rules(t), t.part.select("p_name"), "p_name")
    return out.select("rule_id", "match_strength", F.array_join("matched_origin", ",").alias("origins"), F.array_join("matched_destination", ",").alias("destinations"))


@query(
    "j16_rule_matches",
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part), r(rule_id, w, side, re) AS (VALUES ('c1', 0.5::DOUBLE, 'origin', '^[B-R]L?[A-U]E? .*$'), ('c1', 0.5, 'destination', '^[^A-R].*[TG]$'), "
    "('c2', 0.75, 'origin', '^RED .....T?.*$'), ('c2', 0.75, 'destination', '^LARGE BOLT$')) SELECT DISTINCT rule_id, w AS match_strength, side, name FROM r JOIN n ON regexp_matches(upper(name), re)",
)
def _(t):
    """A row per rule, side and name, with bracket classes in the patterns."""
    rules = t.spark.createDataFrame(
        [
            ("c1", 0.5, ["[b-r][A-U] *", "[b-r]l[a-u] *", "[b-r][a-u]e *", "[b-r]l[a-u]e *"], ["[!a-r]*[tg]"]),
            ("c2", 0.75, ["red ?????*"], ["large bolt", None]),
        ],
        "rule_id string, weight double, origin array<string>, destination array<string>",
    )
    return rule_matches(rules, t.part, "p_name")


def _catalogue(t):
    """Part types and brands as variables; the alias is the first word of the part name."""
    return t.part.groupBy(F.col("p_brand").alias("variable"), F.lower(F.substring("p_type", 1, 1)).alias("mode_id")).agg(
        F.collect_set(F.split("p_name", " ")[1]).alias("aliases")
    )


@query(
    "j17_catalogue_modes",
    "WITH c AS (SELECT p_brand AS variable, lower(left(p_type, 1)) AS mode_id, split_part(p_name, ' ', 2) AS alias FROM part), n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part) "
    "SELECT mode_id, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables FROM c JOIN n ON upper(alias) = upper(name) GROUP BY mode_id",
)
def _(t):
    names = t.part.select(F.split("p_name", " ")[1].alias("name"))
    modes = J.catalogue_match(_catalogue(t), names)[1]
    return modes.select("mode_id", F.array_join("matched_variables", ",").alias("variables"))


@query("j18_with_scalars", "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 8) AS share FROM orders")
def _(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    return J.with_scalars(t.orders.select("o_orderkey", "o_totalprice"), total).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("total"), 8).alias("share"))


def _wide_orders(t):
    return t.orders.join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"), "o_custkey"
    )


def _split(t):
    wide = _wide_orders(t)
    return wide, R.normalise(
        wide, "o_orderkey", {"customers": ["o_custkey", "c_name", "c_mktsegment", "c_nationkey"]},
        {"states": ("state_id", ["o_orderstatus", "o_orderpriority"], "ST_")},
    )


@query(
    "u09_normalised_fact",
    "WITH s AS (SELECT o_orderstatus, o_orderpriority, 'ST_' || lpad(CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS VARCHAR), 6, '0') AS state_id FROM orders GROUP BY ALL) "
    "SELECT o_orderkey, o_custkey, o_totalprice, state_id FROM orders JOIN s USING (o_orderstatus, o_orderpriority)",
)
def _(t):
    return _split(t)[1]["fact"].select("o_orderkey", "o_custkey", "o_totalprice", "state_id")


@query("j19_reconstruction_gap", "SELECT count(*) AS rows_differing FROM orders WHERE false")
def _(t):
    wide, tables = _split(t)
    rebuilt = tables["fact"].join(tables["states"], "state_id").join(tables["customers"], "o_custkey")
    return R.reconstruction_gap(wide, rebuilt).agg(F.count(F.lit(1)).alias("rows_differing"))


@query(
    "j20_coverage",
    "SELECT count(*) AS \"rows\", count(r) AS resolved_rows, count(*) - count(r) AS unresolved_rows, round(count(r) / count(*), 6) AS coverage FROM "
    "(SELECT coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_regionkey = 1 THEN n_name END) AS r FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)",
)
def _(t):
    one = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    two = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = t.orders.select("o_custkey").join(one, "o_custkey", "left").join(two, "o_custkey", "left")
    return J.coverage(rows, F.coalesce("c_mktsegment", "n_name"), 0.1)


@query(
    "a17_key_counts",
    "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS \"rows\", "
    "CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS null_key_rows, count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM g",
)
def _(t):
    return Q.key_counts(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "a17_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS \"rows\" FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "a18_dependency_violations",
    "SELECT o_custkey, count(*) AS distinct_rows FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders) GROUP BY o_custkey HAVING count(*) > 1",
)
def _(t):
    return Q.dependency_violations(t.orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


@query(
    "a18_dependency_examples",
    "WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), b AS (SELECT o_custkey FROM d GROUP BY o_custkey HAVING count(*) > 1 ORDER BY o_custkey LIMIT 5) SELECT d.* FROM d SEMI JOIN b USING (o_custkey)",
)
def _(t):
    return Q.dependency_examples(t.orders, ["o_custkey"], ["o_orderpriority"])


@query(
    "a19_value_conflicts",
    "WITH p AS (SELECT l_suppkey, l_returnflag, count(*) AS row_count FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey, count(*) AS distinct_values FROM p GROUP BY l_suppkey HAVING count(*) > 1) SELECT l_suppkey, l_returnflag, row_count, distinct_values FROM p JOIN c USING (l_suppkey)",
)
def _(t):
    return Q.value_conflicts(t.lineitem, "l_suppkey", "l_returnflag")


@query(
    "q11_validation_report",
    "SELECT * FROM (VALUES ('table_exists', 'orders', 'PASS', ''), ('required_columns', 'orders', 'PASS', ''), ('table_exists', 'lineitem', 'PASS', ''), ('required_columns', 'lineitem', 'FAIL', 'l_color'), "
    "('table_exists', 'weather', 'FAIL', 'missing')) v(\"check\", \"table\", status, detail) "
    "UNION ALL SELECT 'primary_key_unique', 'orders', CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END, '0' FROM orders "
    "UNION ALL SELECT 'primary_key_not_null', 'orders', 'PASS', CAST(count(*) FILTER (o_orderkey IS NULL) AS VARCHAR) FROM orders "
    "UNION ALL SELECT 'natural_key_unique', 'lineitem', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) "
    "UNION ALL SELECT 'foreign_key_orders', 'lineitem', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) "
    "UNION ALL SELECT 'row_count', 'orders', CASE WHEN count(*) <> 1 THEN 'FAIL' ELSE 'PASS' END, CAST(count(*) AS VARCHAR) FROM orders",
)
def _(t):
    specs = [
        Q.TableSpec("orders", ["o_orderkey", "O_CUSTKEY".lower()], primary_key=["o_orderkey"], expected_rows=1),
        Q.TableSpec("lineitem", ["l_orderkey", "l_color"], natural_key=["l_orderkey", "l_linenumber"], foreign_keys=[({"l_orderkey": "o_orderkey"}, "orders")]),
        Q.TableSpec("weather", ["x"]),
    ]
    return Q.validation_report({"orders": t.orders, "lineitem": t.lineitem}, specs)


# ---------------------------------------------------------------- the text star set, through the gold pipeline


def star_sources(t):
    """The eight source tables as text, with decimal commas, blanks and missing references as in real exports."""
    from gridpulse.plans.gold import StarSources

    def comma(col):
        return F.regexp_replace(F.col(col).cast("decimal(18,4)").cast("string"), "\\.", ",")

    k = F.col("o_orderkey")
    lines = t.spread("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    fact_rows = lines.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), F.col("l_orderkey").cast("string").alias("event_id"),
        F.col("l_partkey").cast("string").alias("FID_VANO"), F.col("l_suppkey").cast("string").alias("trafo_profile_id"),
        F.regexp_replace((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").cast("string"), "\\.", ",").alias("UITI_VANO"),
    )
    events = t.orders.select(
        k.cast("string").alias("event_id"), F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("FECHA"), F.lit("1,5").alias("DURACION"),
        comma("o_totalprice").alias("UITI"), F.when(k % 3 == 0, "").otherwise((k % 50).cast("string")).alias("TOT_USUS"), F.lit("2").alias("CNT_TRF"),
        F.substring("o_orderpriority", 1, 1).alias("COD_CAUSA"), F.when(k % 2 == 0, "EQ9").alias("COD_EQ_PROTEGE"),
    )
    p = F.col("p_partkey")
    spans = t.part.select(
        p.cast("string").alias("FID_VANO"), F.when(p % 7 == 0, " ").otherwise(F.concat(F.lit("SW"), p % 90)).alias("FID_SW"), (p % 300).cast("string").alias("FID_APOYO_FIN"),
        F.when(p % 4 > 0, F.concat(F.lit("MUN"), p % 4)).alias("municipio"), F.lit("-75,5").alias("X1"), F.lit("5,1").alias("Y1"), F.lit("-75.4").alias("X2"), F.lit("5.2").alias("Y2"),
        F.lit("10").alias("LONGITUD"), F.lit("ACSR").alias("CONDUCTOR"), F.col("p_type").alias("TIPO_TAX"),
    )
    equipment = t.spark.range(80).select(
        F.concat(F.lit("SW"), "id").alias("FID_SW"), F.concat(F.lit("CIR-"), F.col("id") % 9).alias("CIRCUITO"), F.lit("Reconectador").alias("TIPO"),
        F.lit("5").alias("T_USUS_EQ_PROT"), F.lit("3").alias("CNT_VN_SW"),
    )
    supports = t.part.select((p % 300).cast("string").alias("FID_APOYO_FIN")).distinct().withColumn("ALTURA", F.lit("10"))
    causes = t.orders.select(F.substring("o_orderpriority", 1, 1).alias("COD_CAUSA"), F.col("o_orderpriority").alias("DESC_CAUSA")).distinct().where("COD_CAUSA <> '5'")
    s = F.col("s_suppkey")
    transformers = t.supplier.select(
        s.cast("string").alias("trafo_profile_id"), F.concat(F.lit("TMUN"), s % 2).alias("municipio"), F.when(s % 2 == 0, (s % 11).cast("string")).alias("CNT_USUS"), F.lit("25").alias("CAPACIDAD_NOMINAL")
    )
    weather = fact_rows.join(events.select("event_id", "FECHA"), "event_id").select("FID_VANO", "FECHA").distinct().where("FID_VANO % 5 = 0").withColumn("temp_0", F.concat("FID_VANO", F.lit(",5")))
    return StarSources(fact_rows, events, spans, equipment, supports, causes, transformers, weather, ["temp_0"])


STAR_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS event_id, CAST(l_partkey AS VARCHAR) AS span_id, CAST(l_suppkey AS VARCHAR) AS profile_id, round(l_extendedprice * (1 - l_discount), 4) AS span_impact,
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(o_totalprice, 4) AS event_impact, CASE WHEN left(o_orderpriority, 1) <> '5' THEN o_orderpriority END AS cause,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 90 < 80 THEN 'CIR-' || (p_partkey % 90) % 9 ELSE 'Sin circuito' END AS circuit,
 CASE WHEN p_partkey % 4 > 0 THEN 'MUN' || p_partkey % 4 ELSE 'TMUN' || s_suppkey % 2 END AS municipality,
 CASE WHEN p_partkey % 7 <> 0 THEN 'SW' || p_partkey % 90 WHEN o_orderkey % 2 = 0 THEN 'EQ9' ELSE 'Sin equipo' END AS equipment,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 90 < 80 THEN 'Reconectador' ELSE 'Proteccion' END AS equipment_type, p_type AS element_type,
 CAST(coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 11 END, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END, 0) AS DOUBLE) AS users,
 CASE WHEN p_partkey % 5 = 0 THEN p_partkey || ',5' END AS temp_0, CASE WHEN l_extendedprice * (1 - l_discount) > 0 THEN 1 ELSE 0 END AS impact_flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""


@query("j01_silver_fact", STAR_SQL)
def _(t):
    from gridpulse.plans.gold import silver_fact

    return silver_fact(star_sources(t)).select(
        "event_id", "span_id", "profile_id", F.round("span_impact", 4).alias("span_impact"), text_day(), F.round("event_impact", 4).alias("event_impact"), "cause",
        "circuit", "municipality", "equipment", "equipment_type", "element_type", "users", "temp_0", "impact_flag",
    )


@query(
    "f08_gated_map_tables",
    "SELECT 'asset' AS point_kind, count(*) AS n, round(min(5.15::DOUBLE), 4) AS latitude FROM part UNION ALL SELECT 'event', count(*), 5.1 FROM lineitem",
)
def _(t):
    from gridpulse.plans.gold import map_tables, silver_fact, span_assets

    src = star_sources(t)
    points = map_tables(silver_fact(src), span_assets(src, "2024-05-01"))["map_points"]
    return points.groupBy("point_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("latitude"), 4).alias("latitude"))
