"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and three times for the median; results are
computed in full and written nowhere.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from wardflow.bindings import catalog
from wardflow.session import local_session

HEADLINE = [
    "cq_01_visit_statistics",
    "cq_02_income_report",
    "cq_03_referral_pivot",
    "cq_06_waiting_list",
    "cq_07_waiting_board",
    "cq_08_visit_tariff",
    "cq_09_price_totals",
    "cq_11_delivery_overview",
    "cq_15_visit_message_queue",
    "cq_18_by_album",
    "cq_19_mixed_all",
    "cq_20_navigate",
    "cq_22_order_sheet",
    "cq_23_sync_in",
    "ag_08_name_list",
    "wn_03_latest_and_rest",
    "dm_03_upsert",
    "dm_14_workflow",
]
ROUNDS = 3


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.bound(name)(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, name, folder)
        times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(ROUNDS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
