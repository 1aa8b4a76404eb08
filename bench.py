"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
Each query is timed once after a short warm-up, from building the plan to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkbi.plans.registry import load  # noqa: E402
from sparkbi.session import build_session  # noqa: E402

HEADLINE = (
    "group_sum_filtered", "group_mean_series", "filter_in_ne_null", "hist_price", "box_quantity_by_mode",
    "heat_priority_status", "scatter_sample", "metrics_all", "dashboard_long", "profile_orders",
    "recipe_fill_median", "recipe_dedup_first", "recipe_aggregate", "recipe_pivot", "recipe_join_left_nullkeys",
    "recipe_chain", "rel_spearman", "rel_cramers_v", "rel_eta_squared", "rel_daily_trend", "rel_latest_grain",
    "rel_ranked", "fold_state", "asof_attach", "doc_participants", "doc_snapshots", "inventory_cost",
    "lane_diff", "bucket_cohorts", "price_model", "compact_newest", "stream_compact", "publish_roundtrip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registered = load()
    registered["group_sum_filtered"].build(spark, folder).collect()
    timed = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timed[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(timed.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": timed, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
