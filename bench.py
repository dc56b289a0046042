"""Time the headline queries: one warm-up scan, then each query once, written to a no-op sink.

A query that takes longer than LIMIT is ended and has no time; none begins after TOTAL. The line of results is printed in any case,
also when the process is told to end.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.runs import QUERIES  # noqa: E402

HEADLINE = [
    "i8_grid_unpivot", "c3_high_limits", "c7_cleaned_lines", "c8_unit_master", "d2_longest_gaps",
    "r3_category_reconciliation", "w3_trailing_means", "w6_trailing_mad", "a2_isolation_forest", "a5_anomaly_report",
    "a7_peer_comparison", "p1_kernel_change_points", "p6_change_report", "h9_health_scores", "g1_unit_profiles",
    "g4_k_means", "f3_feature_matrix", "f6_holt_winters", "f8_backtest", "f10_climatology", "f12_cross_year_validation",
    "n8_recommendations", "s1_saving_scenarios", "u5_category_stats", "u8_top_units", "st2_daily_totals",
]


# Seconds for a query, and after which none begins.
LIMIT, TOTAL = 240, 1400


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("ledger-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float | None] = {}

    def report(*_) -> None:
        done = [t for t in times.values() if t is not None]
        print(json.dumps({"metric": "headline_total", "value": round(sum(done), 2), "unit": "sec", "queries": times,
                          "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}), flush=True)
        if _:
            os._exit(1)

    signal.signal(signal.SIGTERM, report)
    began = time.perf_counter()
    for name in names:
        times[name] = None
        start = time.perf_counter()
        if start - began > TOTAL:
            continue
        over = threading.Event()
        timer = threading.Timer(LIMIT, lambda: (over.set(), spark.sparkContext.cancelAllJobs()))
        timer.start()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 2)
        except Exception:
            if not over.is_set():
                raise
        finally:
            timer.cancel()
        print(name, times[name], file=sys.stderr, flush=True)
    report()


if __name__ == "__main__":
    main()
