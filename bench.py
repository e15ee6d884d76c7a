"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or "all"
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from recordmill.plans.catalog import QUERIES

HEADLINE = [
    "scan_pruned", "curate_funnel", "classify_tiered", "inherit_group_labels", "preference_pairs", "audit_impact",
    "group_labels", "group_interval", "labels_as_of", "train_percentile", "score_quantiles", "auc", "auc_by_cell",
    "average_precision", "spearman", "kendall_tau", "split_stratified", "split_grouped", "bootstrap_groups",
    "paired_bootstrap", "permutation_auc", "fit_temperature", "calibration_report", "tier_metrics", "select_then_test",
    "ref_max_similarity", "participation_ratio", "near_dup_groups", "consensus_agreement", "forward_validation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = builder.config("spark.checkpoint.dir", scratch).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("group_labels", "auc"):
        QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
