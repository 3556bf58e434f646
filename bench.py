"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query runs in full into a no-op sink after one warm-up scan.
"""

from __future__ import annotations

import json
import os
import time

from knownby.session import local_session

HEADLINE = (
    "b1_latest_vintage", "b6_vintage_history", "b10_panel_as_of", "b15_members_history", "b18_resolve_identifiers",
    "a15_append_bars", "c3_horizon_returns", "d2_d7_risk_summary", "e3_abnormal_returns_two_factors",
    "e8_normalize_factor", "e11_rolling_beta", "f4_f5_event_windows", "g2_revision_breadth", "i1_put_call_ratios",
    "j3_mean_test_hac_whole_table", "j5_benjamini_hochberg", "k3_screen_matches", "k5_screen_history",
    "l5_l7_l9_portfolio_evaluation", "n2_validate_claims", "o3_daily_price_features", "o6_daily_cards",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, memory="20g", app="bench")
    from knownby.catalog import QUERIES

    for name in ("lineitem", "events", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
