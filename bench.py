"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR   table directory       (default /root/testdata/sf0.1)
BENCH_CPUS     local threads         (default 8)
BENCH_RUNS     timed runs per query  (default 3; the median counts)
BENCH_ONLY     comma-separated names, or "all" (default the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from panelmill.plans.catalog import CATALOG
from panelmill.session import build_session

HEADLINE = (
    "consolidate_daily", "dq_profile", "clean_panel", "cleaning_funnel", "inactive_entities", "flag_counts",
    "prefix_cardinality", "attach_company", "latin_ascii_text", "entity_coverage", "daily_change_stats",
    "risk_return", "top_movers", "valuation_hist", "monthly_close", "cpi_crosstab", "benchmark_wide",
    "panel_join_benchmark", "cohort_index", "best_k_series", "compare_growth", "choices_fund",
    "station_documents", "station_snapshot",
)


def run_once(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_ONLY", "")
    names = list(CATALOG) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run = CATALOG[name].run
        run_once(spark, run, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, run, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
