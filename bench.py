"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores).
Each query runs once to warm up and then BENCH_RUNS times; the fastest run counts.
Results are written to the no-op sink, so every row is computed and none is collected.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "profile_columns", "describe", "distinct_count", "missing_total", "duplicate_rows", "iqr_outliers",
    "exact_quantiles", "target_correlations", "distributions", "correlation_matrix", "redundant_pairs", "vif",
    "leakage_by_correlation", "mutual_information", "leakage_probability", "missing_pattern",
    "infer_types", "detect_timeseries", "sample_adequacy", "signals_by_segment", "health_score",
    "clean", "mahalanobis_scores", "outlier_drivers", "drift_report", "distribution_shift",
    "comparison_verdict", "target_encode", "quantile_bin", "lag_features", "stratified_split", "recommendations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tablescope-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tablescope.plans import queries
    queries.load()

    def run(name: str) -> float:
        start = time.time()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
