"""Time the registered queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES
(comma-separated names) can be set.  The headline queries are each run twice and
the second run counts; every other registered query runs once afterwards, those of
whole model grids last.  The line is printed after the headline and again, longer, after every
further query: the last line of the output is the one that counts, whenever the run
is stopped.  No query starts after BENCH_SECONDS (default 1500).
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.queries import QUERIES  # noqa: E402
from eventloom.queries import flagship  # noqa: E402,F401
from eventloom.session import local_session  # noqa: E402

HEADLINE = (
    "window_matrix", "signals_all_windows", "signals_all_domains", "meas_persistent_positivity", "drug_repeat_at_least_n",
    "cond_episodes_gap", "demographics", "build_cohort_relaxed", "ancestor_flags", "acute_severity", "engagement", "lab_summary",
    "series_dynamics", "titer_features", "late_divergence", "auroc", "net_benefit", "cal_slope", "paired_tests", "table_one",
    "stratified_split", "exact_quantiles",
)


# Whole grids, minutes each on a few cores; 100 repeats of them, hours.
LAST = ("cross_site", "boruta", "boosted_repeat", "forest_repeat", "importance", "logistic_repeat", "subtype_runs", "run_repeats")


def timed(fn, spark, sf_dir) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus)
    seconds: dict[str, float] = {}

    def told() -> dict:
        head = round(sum(s for n, s in seconds.items() if only or n in HEADLINE), 3)
        return {
            "metric": "headline_queries_total", "value": head, "unit": "sec", "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus) if cpus.isdigit() else cpus,
        }

    def stopped(*_) -> None:
        print(json.dumps(told()), flush=True)
        os._exit(0)

    signal.signal(signal.SIGTERM, stopped)
    began, limit = time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "1500"))
    for name in only or HEADLINE:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
    print(json.dumps(told()), flush=True)
    rest = [] if only else [n for n in QUERIES if n not in seconds and n not in LAST] + list(LAST)
    for name in rest:
        if time.perf_counter() - began > limit:
            break
        seconds[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
        print(json.dumps(told()), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
