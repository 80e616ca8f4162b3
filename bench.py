"""Time the headline queries, warm, and print one JSON line: median seconds, and of these the seconds for building the plan.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridscore import plans  # noqa: E402
from gridscore.plans import registry  # noqa: E402
from gridscore.session import build_session  # noqa: E402

HEADLINES = (
    "flagship_language_ranking",
    "x2_parse_text",
    "x3_complete_annotation",
    "x5_normalize",
    "x6_repair",
    "g2_by_language",
    "g4_error_classes",
    "g11_all_slices",
    "g13_behavior_rates",
    "g14_normalized_macro_mean",
    "g15_common_cells",
    "g17_common_cells_by_expectation",
    "g20_group_outcomes",
    "g22_validity_gate",
    "g23_call_cost",
    "g24_cost_rollup",
    "g25_latency_summary",
    "g29_participant_progress",
    "g32_paired_breakdown",
    "g33_cer_statistics",
    "g34_cer_buckets",
    "j5_pending_translations",
    "j6_unresolved_failures",
    "j7_fork_copy",
    "j18_paired_conditions",
    "j22_batch_correlation",
    "p12_item_rules",
    "p18_bucket_balance",
    "w1_latest_failure",
    "w4_request_chunks",
    "w5_recent_throttle_failures",
    "w6_invalid_streak",
    "w8_context_window",
    "w9_round_robin",
    "x10_redaction",
    "x13_error_class",
    "x20_sensitive_text",
    "s10_fingerprint",
    "t1_running_counters",
    "f1_annotate_pending",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.load()
    seconds, build = {}, {}
    for name in HEADLINES:
        runs = []
        # The first run compiles and is not counted; short queries are run three times.
        while len(runs) < (4 if not runs or runs[0][1] < 3 else 2):
            start = time.perf_counter()
            frame = registry.QUERIES[name](spark, sf_dir)
            built = time.perf_counter()
            frame.write.format("noop").mode("overwrite").save()
            runs.append((built - start, time.perf_counter() - start))
        build[name] = round(median(r[0] for r in runs[1:]), 3)
        seconds[name] = round(median(r[1] for r in runs[1:]), 3)
    match = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "build": build,
        "sf": float(match.group(1)) if match else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
