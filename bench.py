"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`queries` are seconds of the first run of each, `warm` of the second; `rows` are its rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tradewind.plans import registry

NAMES = [
    "latest_prices", "biggest_changes_365", "search_basic", "product_offers", "list_revaluate", "list_totals", "stats", "export_catalog", "snapshot_rows", "price_mode", "upsert_product_fold", "event_latest", "event_tumbling",
    "movers_up", "list_review", "group_offers", "canonical_roots", "token_blocking_pairs", "fuzzy_candidates", "event_sessions", "search_indexed",
]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master(f"local[{cpus}]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    took, warm, rows = {}, {}, {}
    for name in NAMES:
        for seconds in (took, warm):
            began = time.time()
            registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
        rows[name] = registry.queries()[name](spark, sf).count() if took[name] < 20 else None
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm, "rows": rows, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
