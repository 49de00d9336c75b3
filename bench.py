"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Each
query runs from the source tables: nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from dalyworks.workload.queries import queries

HEADLINE = (
    "population",
    "cause_totals",
    "burden_rates",
    "valuation",
    "diff_national",
    "ihme_region_diff",
    "region_choropleth",
    "bins_dalys",
    "extreme_regions",
    "income_costs",
    "table1",
    "table2",
    "headline_metrics",
    "mc_ci",
    "mc_rr_grid",
)


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(shared)


def run(shared: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dalyworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", shared)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["cause_totals"](spark, folder).collect()  # start-up and code generation
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
