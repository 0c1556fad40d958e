"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from dipstick.catalog import QUERIES
from dipstick.session import local_session

# The first one reads raw order lines; the others start from the daily ledger, which is written
# once and whose cost is reported on its own as ``ledger_write``.
HEADLINE = (
    "f18_ledger_build",
    "serving_features",
    "clean_table",
    "w01_rolling_mean",
    "w06_ewm_weekday",
    "w10_days_since_refill_by_position",
    "a01_sales_by_weekday",
    "a07_refill_pivot",
    "a11_describe",
    "a23_outlier_report",
    "a24_winsorise",
    "a26_correlation_matrix",
    "c04_lenient_dates",
    "c07_coerce_numbers",
    "f05_walk_forward",
    "f07_refill_decision",
    "f16_simulation",
    "j02_weekday_lookup",
    "m04_neighbours",
    "m10_roc_auc_overall",
    "m11_classification_report",
    "u02_exact_duplicates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "dipstick-bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the JVM's workers

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    seconds = {}
    start = time.perf_counter()
    run(QUERIES["s10_row_count_check"](spark, folder))  # the first use writes the ledger
    seconds["ledger_write"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
