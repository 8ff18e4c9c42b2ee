"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then up to three times; its time is the median.  Rows are
drained through the ``noop`` sink, so that the whole plan runs and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tracelab.plans.catalogue import QUERIES
from tracelab.session import local_session

HEADLINE = [
    "d1_daily_herd_curve",
    "d3_all_resolutions",
    "t2_common_herd_grid",
    "t3_collision_backfill",
    "e5_null_runs",
    "t6_bounded_interpolation_exclusive",
    "t8_zero_runs_to_null_whole",
    "e13_moving_average",
    "e1_previous_scores",
    "c1_interval_join",
    "c5_hourly_lookup",
    "c6_exogenous_window",
    "m1_labelled_samples",
    "n1_quotient",
    "n5_standard_scale",
    "n11_step_sequence",
    "e14_rolling_windows",
    "s1_stft_power",
    "s2_cwt_magnitude",
    "m2_kfold",
    "m12_auc_per_fold",
    "m15_percentile_interval",
    "m16_bootstrap_metrics",
    "f2_top_per_farm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_SECONDS", "600"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, app="bench")
    times: dict[str, float] = {}
    start = time.time()
    for name in wanted:
        taken = []
        for i in range(runs + 1):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                taken.append(time.time() - t)
            if taken and time.time() - start > budget:
                break
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, sum of median warm times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cores,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
