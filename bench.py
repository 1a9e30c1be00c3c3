"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  folder with the test tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores                   (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillsight.catalogue.all import QUERIES  # noqa: E402
from tillsight.session import build_session  # noqa: E402

HEADLINE = (
    "fat_table", "cleaned_transactions", "customer_business_rollup", "latest_customer", "top_n_per_key",
    "percentile_bins", "eda_x03", "eda_x08", "eda_x09", "eda_x17", "customer_features", "item_tanimoto",
    "knn_customers", "numeric_boxes", "categorical_groups", "rec_random", "rec_popular", "rec_conditional",
    "rec_tanimoto", "rec_knn", "rec_neighbour_to_item", "rec_als", "rec_ensemble", "evaluate_tanimoto",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before the clock runs.
    QUERIES["eda_x04"](spark, sf_dir).collect()
    QUERIES["numeric_boxes"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir))}))


if __name__ == "__main__":
    main()
