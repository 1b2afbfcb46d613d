"""Times the headline queries on whole tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyspark.plans import catalogue
from tallyspark.session import build_session

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = (
    "a03_cost_rollup",
    "a01_trade_summary",
    "a17_trade_outliers",
    "a19_value_engineering",
    "a21_purchase_list",
    "a23_sections",
    "a14_budget_estimates",
    "j02_label_overrides",
    "j03_line_candidates",
    "j05_choose_material",
    "j07_missing_trades",
    "j16_expected_counts",
    "w01_line_numbers",
    "w03_version_changes",
    "w04_rate_history",
    "k02_replace_scope",
    "k03_line_edits",
    "k06_bill_sheet",
    "s06_parse_responses",
    "s09_cad_layers",
    "u01_formulas",
    "e06_distinct_contents",
    "v01_nearest_exact",
    "st02_live_totals",
    "st03_failure_rates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    registered = catalogue.queries()
    spark.range(1_000_000).selectExpr("sum(id % 7)").collect()  # start the JVM's code paths once
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + REPEATS):  # the first run loads classes and does not count
            begun = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr)
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
