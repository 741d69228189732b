"""A spread of registered queries against their SQL on the smallest test set."""

from pathlib import Path

import pytest

from gridpulse.workload import load
from tools.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
NAMES = """a01_event_rollup a02_daily_impact a04_daily_attribution a10_top_attribution a23_describe_numeric f03_typed_filters j01_star_join
j01_silver_fact j05_snapshot_join j09_nearest_reference j11_downstream j13_node_bridge j14_lookback_hours w05_point_reasons w08_ranked_points
w13_surrogate_ids w14_bounded_memory m03_stratified_split d01_word_chunks d04_lexical_top_k d06_cosine_top_k u09_normalised_fact q06_summary_daily s16_upsert""".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    queries, sql = load()
    got, want = queries[name](spark, FOLDER).toPandas(), duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b) and a.equals(b)


def test_names_and_sql_keys():
    queries, sql = load()
    assert set(sql) <= set(queries) and len(queries) > 200
