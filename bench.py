"""Time the headline queries on the sf0.01 tables and on the chosen ones, both warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridpulse.session import build_session  # noqa: E402
from gridpulse.workload import load  # noqa: E402

HEADLINE = """
a01_event_rollup a02_daily_impact a03_circuit_summary a04_daily_attribution a05_environment_daily a08_two_level_daily
a10_top_attribution a12_event_options a14_month_view a17_key_counts a21_histogram a22_density_by_category
a23_describe_numeric a27_correlations a34_strike_summary
j01_star_join j04_missing_keys j05_snapshot_join j09_nearest_reference j10_points_near_segments j11_downstream
j13_node_bridge j14_lookback_hours j16_wildcard_rules j19_reconstruction_gap
w02_robust_z w05_point_reasons w08_ranked_points w09_enriched_points w11_fill_from_latest w13_surrogate_ids w14_bounded_memory
m03_stratified_split d01_word_chunks d04_lexical_top_k d06_cosine_top_k d10_claim_class d12_answer_sections d13_route_tools
q01_dashboard_context q07_interpretability_points q08_conditional_histogram q11_validation_report s21_profile u07_wide_to_long
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    queries = load()[0]
    if chosen == ["all"]:
        chosen = list(queries)
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(where: str) -> dict[str, float]:
        times: dict[str, float] = {}
        for name in chosen:
            start = time.perf_counter()
            queries[name](spark, where).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            if os.environ.get("BENCH_VERBOSE"):
                print(name, times[name], file=sys.stderr, flush=True)
        return times

    smaller = Path(folder).parent / "sf0.01"
    small = {}
    if smaller.exists() and smaller != Path(folder):
        timed(str(smaller))  # compiles the code of every query, so that both sizes are timed warm
        small = timed(str(smaller))
    times = timed(folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "sf0.01": {"value": round(sum(small.values()), 3), "queries": small},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
