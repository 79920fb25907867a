"""Times the headline queries and prints one JSON line.

Each figure is the better of two full runs; the result goes to a sink that
computes every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspark import build_session  # noqa: E402
from ledgerspark.operators import analytics, filters, identity, matching  # noqa: E402
from ledgerspark.plans import queries as registered  # noqa: E402
from ledgerspark.plans.demo import wide_rules  # noqa: E402
from ledgerspark.plans.views import Views  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = set(sys.argv[1:])


def workloads(spark, v: Views) -> dict:
    # The test file is one row group, which one task would read; a stored table has many files.
    stored = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/txn_lineitem"
    identity.with_transaction_id(v.txn_lineitem).repartition(int(CPUS)).write.parquet(stored)
    identified = spark.read.parquet(stored)
    lines = identified.drop("Transaction_ID")
    found = {
        "normalize_union": lambda: registered.united(v),
        "transaction_ids": lambda: identity.with_transaction_id(lines),
        "unique_ids": lambda: identity.with_unique_ids(identified),
        "suffix_repeated_keys": lambda: registered.QUERIES["txn_id_suffix"](spark, FOLDER),
        "categorize_demo": lambda: registered.demo_categorized(v),
        "categorize_25_rules": lambda: matching.categorize(lines, wide_rules(25)),
        "categorize_500_rules": lambda: matching.categorize(lines, wide_rules(500)),
        "categorize_2000_rules": lambda: matching.categorize(lines, wide_rules(2000)),
        "rule_performance": lambda: registered.QUERIES["rule_performance"](spark, FOLDER),
        "effective_labels": lambda: registered.demo_effective(v),
        "category_distribution": lambda: analytics.category_distribution(registered.demo_effective(v)),
        "yearly_pivot": lambda: analytics.yearly_pivot(registered.demo_marked(v)),
        "filter_period": lambda: filters.by_period(v.txn_orders, "this_year", "1999-06-15"),
        "search_description": lambda: filters.search_description(lines, "red .*promo"),
        "label_upsert": lambda: registered.QUERIES["label_upsert"](spark, FOLDER),
        "row_positions": lambda: registered.QUERIES["row_positions"](spark, FOLDER),
        "rules_overview": lambda: registered.QUERIES["rule_overview"](spark, FOLDER),
        "scan_csv_files": lambda: registered.QUERIES["scan_csv_files"](spark, FOLDER),
    }
    return {name: build for name, build in found.items() if not ONLY or name in ONLY}


def run(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "ledgerspark-bench",
        master=f"local[{CPUS}]",
        spark_driver_memory="16g",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions=CPUS,
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, build in workloads(spark, Views(spark, FOLDER)).items():
        timings[name] = round(min(run(build), run(build)), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
