"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "etl_silver_to_gold", "etl_dedup_pk", "etl_bronze_to_silver", "agg_monthly_usage", "agg_summary_table", "agg_profile", "join_point_in_time", "join_positions_prices",
    "join_tariff_band", "win_scd2", "win_lag_features", "win_sliding_30d", "win_lift_deciles", "dq_suite_select", "dq_unique", "dq_score_window", "pii_scan_values", "pii_row_guard",
    "gov_k_anonymity", "lin_build_graph", "lin_neighbours", "fs_compute", "fs_backfill", "fs_parity", "ml_auc", "ml_calibration", "drift_psi", "drift_ks", "ano_usage", "ano_fraud",
    "fc_load", "fc_metrics", "seg_customers", "clv_customer", "price_optimise", "risk_var", "risk_stale_prices", "ab_analyse", "kb_index", "kb_search", "kb_relevance", "cost_gate",
    "cost_breakdown", "ops_error_freq", "ops_latency_pct", "ops_exec_status", "conv_append", "st_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from voltlake import plans
    from voltlake.session import build

    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(plans.QUERIES)
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    plans.QUERIES["agg_summary_table"](spark, sf_dir).collect()  # start the engine
    times = {}
    for n in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            try:
                plans.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as ex:  # one failing query must not hide the others
                print(n, repr(ex)[:300], file=sys.stderr, flush=True)
                best = None
                break
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        if best is not None:
            times[n] = round(best, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
