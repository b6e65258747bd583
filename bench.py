"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from basetrack import entrypoints

HEADLINE = ("interval_sums", "tile_split_sums", "binned_sums", "label_bin_sums", "paired_sums", "window_read_dense", "tile_sums", "zoom_levels", "track_stats", "count_five_prime", "coverage_runs", "cell_counts", "rle_runs", "mate_pairs", "hic_mirror")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, seconds = entrypoints.queries(), {}
    every["track_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers of the JVM
    for name in HEADLINE:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
