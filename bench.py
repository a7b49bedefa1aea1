"""Benchmark: headline queries on the driver tables.

Runs each query to completion (``noop`` sink, so every row is computed but
nothing is collected) on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1); reports the median of ``$BENCH_RUNS`` warm runs
per query and prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "category_performance", "product_ranking", "top_products", "dashboard_stats",
    "sales_daily", "sales_weekly", "sales_monthly", "sales_with_total", "recent_orders",
    "order_status_counts", "orders_list", "inventory_summary", "order_detail",
    "kitchen_tickets", "cart_merge", "stock_allocation", "orders_intake", "status_apply",
    "payment_settlement", "live_order_status", "orders_csv_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]

    from shopflow.plans.catalog import QUERIES
    from shopflow.session import build_session

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=parts,
                          app_name="shopflow-bench", extra={"spark.driver.memory": "16g"})

    def run(k: str) -> float:
        t0 = time.perf_counter()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for k in keys:  # warm-up: JIT, file listing, Python workers
        run(k)
    times = {k: round(statistics.median(run(k) for _ in range(runs)), 3) for k in keys}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
