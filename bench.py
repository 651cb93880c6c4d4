"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads, and
BENCH_QUERIES (optional) a comma-separated list of query names, or ``all``.
"""

from __future__ import annotations

import json
import os
import re
import time

from orderlens.plans.catalog import QUERIES
from orderlens.session import build_session

HEADLINE = [
    "temporal_features",
    "daily_demand",
    "demand_patterns",
    "demand_patterns_simple",
    "merge_patterns",
    "customer_forecast_long",
    "product_forecast_long",
    "customer_product_lookup",
    "lookup_items",
    "dataset_overview",
    "numeric_profile",
    "categorical_profile",
    "dq_duplicates",
    "dq_checks",
    "business_rules",
    "quality_score",
    "series_instances",
    "seasonal_quantile_forecast",
    "forecast_accuracy",
    "recommendations",
    "prediction_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            # one machine: every shuffle read is local, and a table of one file would
            # otherwise be joined by the one task that scanned it
            "spark.sql.adaptive.localShuffleReader.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors' threads and the code cache on something small
    QUERIES["demand_patterns"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
