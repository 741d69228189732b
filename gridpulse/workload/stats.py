"""Statistics and model data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import stats as T
from gridpulse.plans import evaluation, probability
from gridpulse.workload.registry import FACT, fact, query

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a21_histogram",
    "WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z, count(*) AS n FROM lineitem), c AS (SELECT least(CAST(floor((l_extendedprice - a) / ((z - a) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) "
    "SELECT g.bin, round(a + g.bin * (z - a) / 30, 4) AS low, round(a + (g.bin + 1) * (z - a) / 30, 4) AS high, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / b.n, 6) AS probability FROM (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin) g LEFT JOIN c USING (bin), b",
)
def _(t):
    out = T.histogram(t.lineitem, "l_extendedprice")
    return out.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n", F.round("probability", 6).alias("probability"))


GRID = [i * 10.0 for i in range(0, 36)]


@query(
    "a21_density",
    "WITH s AS (SELECT count(*) AS n, stddev_samp(value) * count(*) ** -0.2 AS h FROM events), g AS (SELECT CAST(unnest(range(36)) * 10 AS DOUBLE) AS x) "
    "SELECT x, round(sum(exp(-(((x - value) / h) ** 2) / 2)) / (max(n) * max(h) * 2.5066282746310002), 7) AS density FROM events, g, s GROUP BY x",
)
def _(t):
    return T.density(t.events, "value", GRID).withColumn("density", F.round("density", 7))


@query(
    "a22_density_by_category",
    "WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * count(*) ** -0.2 AS h FROM events GROUP BY event_type HAVING count(*) > 1 AND stddev_samp(value) > 0), g AS (SELECT CAST(unnest(range(36)) * 10 AS DOUBLE) AS x) "
    "SELECT event_type, x, round(sum(exp(-(((x - value) / h) ** 2) / 2)) / (max(n) * max(h) * 2.5066282746310002), 7) AS density FROM events JOIN s USING (event_type), g GROUP BY event_type, x",
)
def _(t):
    return T.density(t.events, "value", GRID, by="event_type").withColumn("density", F.round("density", 7))


@query("a23_value_counts", "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def _(t):
    return T.value_counts(t.lineitem, "l_partkey")


@query(
    "a23_describe_numeric",
    "SELECT count(l_extendedprice) AS \"count\", round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, "
    "round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS max FROM lineitem",
)
def _(t):
    out = T.describe_numeric(t.lineitem, "l_extendedprice")
    return out.select(
        "count", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max"
    )


@query(
    "a23_describe_text",
    "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) SELECT CAST(sum(n) AS BIGINT) AS \"count\", count(*) AS \"unique\", (SELECT p_name FROM c ORDER BY n DESC, p_name LIMIT 1) AS top, max(n) AS freq FROM c",
)
def _(t):
    return T.describe_text(t.part, "p_name")


@query(
    "a27_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE_COLS for b in LINE_COLS),
)
def _(t):
    rows = t.lineitem.select(*LINE_COLS, F.lit(1.0).alias("constant"))
    return T.correlations(rows, [*LINE_COLS, "constant"]).withColumn("r", F.round("r", 6))


@query(
    "a27_target_correlations",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice * (1 - l_discount)), 6) AS r FROM lineitem" for c in LINE_COLS) + ") WHERE abs(r) > 0.1",
)
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return T.target_correlations(rows, LINE_COLS, "target").withColumn("r", F.round("r", 6))


DIMS = list(range(64))
_V = [f"embedding[{i + 1}]::DOUBLE" for i in DIMS]


@query(
    "a28_column_relevance",
    "WITH v AS (SELECT vec_id, label, " + ", ".join(f"{c} AS d{i}" for i, c in enumerate(_V)) + " FROM embeddings), s AS (SELECT *, " + " + ".join(f"exp(d{i})" for i in DIMS) + " AS tot FROM v), "
    "m AS (SELECT 'all' AS scope, " + ", ".join(f"avg(exp(d{i}) / tot) AS d{i}" for i in DIMS) + " FROM s UNION ALL SELECT CAST(label % 3 AS VARCHAR), " + ", ".join(f"avg(d{i})" for i in DIMS) + " FROM s GROUP BY label % 3), "
    "l AS (UNPIVOT m ON " + ", ".join(f"d{i}" for i in DIMS) + " INTO NAME feature VALUE relevance), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY round(relevance, 9) DESC, feature) AS rank FROM l) SELECT scope, feature, round(relevance, 7) AS relevance, rank FROM r WHERE rank <= 20",
)
def _(t):
    masks = t.embeddings.select(F.pmod("label", F.lit(3)).alias("risk"), *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in DIMS])
    return T.column_relevance(masks, [f"d{i}" for i in DIMS], "risk").withColumn("relevance", F.round("relevance", 7))


TERT = "q AS (SELECT quantile_cont(o_totalprice, 0.3333) AS a, quantile_cont(o_totalprice, 0.6666) AS b FROM orders), r AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < a THEN 0 WHEN o_totalprice < b THEN 1 ELSE 2 END AS risk FROM orders, q)"


@query("a29_tertiles", f"WITH {TERT} SELECT o_orderkey, risk FROM r")
def _(t):
    return T.tertile_labels(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "risk")


@query(
    "m01_fill_for_model",
    "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS seg FROM customer) SELECT c_custkey, round(coalesce(bal, -10 * (SELECT max(bal) FROM p)), 4) AS bal, coalesce(seg, 'no aplica') AS seg FROM p",
)
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 6 > 0, F.col("c_acctbal")).alias("bal"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("seg"))
    return T.fill_for_model(rows, ["bal"], ["seg"]).withColumn("bal", F.round("bal", 4))


@query(
    "m01_label_encode",
    "WITH c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)) SELECT p_partkey, code FROM part JOIN c USING (p_name)",
)
def _(t):
    return T.label_encode(t.part.select("p_partkey", "p_name"), "p_name", "code").select("p_partkey", "code")


@query("m01_class_codes", "SELECT p_type AS class, row_number() OVER (ORDER BY p_type) - 1 AS code, count(*) AS \"rows\" FROM part GROUP BY p_type")
def _(t):
    return T.class_codes(t.part, "p_type")


@query(
    "m02_min_max_scale",
    "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS scaled FROM orders",
)
def _(t):
    return T.min_max_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_scaled", 6).alias("scaled"))


@query(
    "m03_stratified_split",
    f"WITH {TERT}, k AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY (o_orderkey * 7919) % 104729, o_orderkey) AS k, count(*) OVER (PARTITION BY risk) AS n FROM r) "
    "SELECT o_orderkey, risk, CASE WHEN k <= round(n * 0.64::DOUBLE) THEN 'train' WHEN k <= round(n * 0.8::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM k",
)
def _(t):
    rows = T.tertile_labels(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    order = F.col("o_orderkey") * 7919 % 104729
    return T.stratified_split(rows, "risk", "o_orderkey", {"train": 0.64, "valid": 0.16, "test": 0.2}, order).select("o_orderkey", "risk", "split")


@query(
    "m04_split_and_mean_fill",
    "WITH p AS (SELECT o_orderkey, CASE WHEN (o_orderkey * 7919) % 1000 < 800 THEN 'train' WHEN (o_orderkey * 7919) % 1000 < 900 THEN 'valid' ELSE 'test' END AS split, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS price FROM orders) "
    "SELECT o_orderkey, split, round(coalesce(price, (SELECT avg(price) FROM p WHERE split = 'train')), 3) AS price FROM p",
)
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 7 > 0, F.col("o_totalprice")).alias("price"))
    rows = T.hash_split(rows, k * 7919 % 1000, {"train": 0.8, "valid": 0.1, "test": 0.1})
    return T.fill_with_train_mean(rows, ["price"]).withColumn("price", F.round("price", 3))


@query(
    "m05_regression_errors",
    "WITH p AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem) SELECT l_returnflag, round(avg((a-p)**2), 1) AS mse, round(sqrt(avg((a-p)**2)), 3) AS rmse, round(avg(abs(a-p)), 3) AS mae, "
    "round(avg(CASE WHEN a <> 0 THEN abs((a-p)/a) END) * 100, 4) AS mape, round(1 - sum((a-p)**2) / (count(a) * var_pop(a)), 5) AS r2 FROM p GROUP BY l_returnflag",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 2000).alias("p"))
    out = T.regression_errors(rows, "a", "p", ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, d).alias(c) for c, d in (("mse", 1), ("rmse", 3), ("mae", 3), ("mape", 4), ("r2", 5))])


FILTERS = [["seleccion", "cause", "1-URGENT", None], ["rango_num", "users", ">", "10"]]


@query(
    "q08_conditional_histogram",
    f"WITH {FACT}, f AS (SELECT span_impact AS v FROM fact WHERE event_family = 'A' AND cause = '1-URGENT' AND users > 10 AND span_impact IS NOT NULL), b AS (SELECT min(v) AS a, max(v) AS z, count(*) AS n FROM f), "
    "c AS (SELECT least(CAST(floor((v - a) / ((z - a) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM f, b GROUP BY 1) SELECT g.bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / b.n, 6) AS probability FROM (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin) g LEFT JOIN c USING (bin), b",
)
def _(t):
    rows = fact(t).withColumn("criteria_group", F.col("event_family"))
    view = probability.conditional_view(rows, "A", "span_impact", FILTERS, ["event_id", "span_id", "profile_id"])
    return view["distribution"].select("bin", "n", F.round("probability", 6).alias("probability"))


@query(
    "q08_conditional_counts",
    f"WITH {FACT} SELECT circuit AS value, count(*) AS n FROM fact WHERE event_family = 'A' AND cause = '1-URGENT' AND users > 10 GROUP BY circuit ORDER BY n DESC, value LIMIT 30",
)
def _(t):
    rows = fact(t).withColumn("criteria_group", F.col("event_family"))
    return probability.conditional_view(rows, "A", "circuit", FILTERS, ["event_id", "span_id", "profile_id"])["distribution"]


@query("q08_filter_options", f"WITH {FACT} SELECT DISTINCT equipment AS value FROM fact WHERE event_family = 'R'")
def _(t):
    return probability.filter_options(fact(t).withColumn("criteria_group", F.col("event_family")), "R", "equipment")


def _traces(t):
    """One trace per assistant message: ids from the turn, checks from the text."""
    turn, conv = F.col("turn"), F.col("conv_id")
    return t.conversations.where("role = 'assistant'").select(
        "conv_id", "turn",
        F.array(*[F.concat(F.lit("c"), (conv + i).cast("string")) for i in range(4)]).alias("retrieved_chunk_ids"),
        F.array(*[F.concat(F.lit("c"), (conv + turn + i).cast("string")) for i in range(2)]).alias("cited_ids"),
        F.size(F.split("text", "\n")).alias("section_count"),
        (F.length("text") % 7 != 0).alias("citation_valid"),
        (F.length("text") % 11 != 0).alias("compliance_valid"),
        F.length("text").alias("latency_ms"),
        (F.length("text") > 20).alias("ready"),
    )


TRACES = """tr AS (SELECT conv_id, turn, ['c' || conv_id, 'c' || conv_id + 1, 'c' || conv_id + 2] AS top, ['c' || conv_id + turn, 'c' || conv_id + turn + 1] AS cited,
 len(string_split(text, chr(10))) AS sections, length(text) AS latency_ms FROM conversations WHERE role = 'assistant'),
sc AS (SELECT conv_id, turn, round(len(list_intersect(top, cited)) / 3.0, 4) AS retrieval_precision_at_3, CASE WHEN latency_ms % 7 <> 0 THEN 1.0 ELSE 0.0 END AS citation_validity,
 round(least(sections, 9) / 9.0, 4) AS answer_completeness, CASE WHEN latency_ms % 11 <> 0 THEN 0.0 ELSE 1.0 END AS compliance_overclaim_rate, CAST(latency_ms AS DOUBLE) AS latency_ms, CASE WHEN latency_ms > 20 THEN 0.0 ELSE 1.0 END AS failure FROM tr)"""


@query("a30_trace_scores", f"WITH {TRACES} SELECT * FROM sc")
def _(t):
    return evaluation.score_traces(_traces(t)).select(
        "conv_id", "turn", "retrieval_precision_at_3", "citation_validity", "answer_completeness", "compliance_overclaim_rate", "latency_ms", "failure"
    )


@query(
    "a31_release_report",
    f"WITH {TRACES}, r AS (SELECT * FROM sc ORDER BY conv_id DESC, turn LIMIT 100) SELECT count(*) AS trace_count, round(avg(retrieval_precision_at_3), 4) AS retrieval_precision_at_3, round(avg(citation_validity), 4) AS citation_validity, "
    "round(avg(answer_completeness), 4) AS answer_completeness, round(avg(compliance_overclaim_rate), 4) AS compliance_overclaim_rate, round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95, round(avg(failure), 4) AS failure_rate, "
    "CASE WHEN avg(citation_validity) >= 1 AND avg(compliance_overclaim_rate) <= 0 THEN 'passed' ELSE 'review_required' END AS release_status FROM r",
)
def _(t):
    recent = evaluation.recent_traces(_traces(t), "conv_id", "turn")
    return evaluation.release_report(evaluation.score_traces(recent))


@query("l05_recent_traces", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn LIMIT 100")
def _(t):
    return evaluation.recent_traces(_traces(t), "conv_id", "turn").select("conv_id", "turn")
