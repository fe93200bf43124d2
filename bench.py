"""Wall seconds of the composite queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from matchlytics.queries.registry import QUERIES

HEADLINE = ("detect_moments", "audio_signals", "scoreboard_signals", "clip_analytics", "reel_plan", "overlay_plan",
            "select_reel", "cluster_signals", "captions_at", "triage_log", "team_kmeans", "motion_path_smoothed", "overlay_schedule", "live_score_changes")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             # tables of a few MB: keep all cores busy instead of merging partitions up to 1 MB
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    times, firsts = {}, {}
    for name in names:
        best = None
        for _ in range(3):  # the first run also pays for class loading and code generation
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            firsts.setdefault(name, round(took, 3))
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "composite_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_runs": firsts,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
