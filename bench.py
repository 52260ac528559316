"""Seconds per headline query over the tables at $BENCH_SF_DIR; prints one JSON line.

Each query is built and run twice into a sink that discards rows; the better run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from shelfwise.session import local_session  # noqa: E402

HEADLINE = [
    "product_market_summary",
    "competitor_price_history",
    "price_trends",
    "undercut_signals",
    "current_signals",
    "price_movements",
    "demand_vs_signals",
    "price_elasticity",
    "forecast_competitor_prices",
    "price_proposals",
    "signal_page_kpis",
    "competitor_kpis",
    "gap_distribution",
    "movement_histogram",
    "platform_price_series",
    "flatten_competitor_prices",
]


def timed(query, spark, folder: str) -> float:
    begun = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores, memory=os.environ.get("BENCH_MEMORY", "12g"))
    queries = registry.queries()
    seconds = {name: round(min(timed(queries[name], spark, folder) for _ in range(2)), 3) for name in HEADLINE}
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
