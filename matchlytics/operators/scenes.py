"""Replay packages: runs of short scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import chunk_no, keys_of
from ..functions.ordered import runs as runs_of


def replay_clusters(scenes: DataFrame, *, by="match_id", max_s: float = 12.0, min_run: int = 3, bucket_seconds: float = 600.0) -> DataFrame:
    """Runs of `min_run` or more consecutive scenes no longer than `max_s`, as signals at the run start."""
    short = F.col("end_s") - F.col("start_s") <= max_s
    found = runs_of(scenes, by, ["start_s", "seq"], short, ["start_s"], bucket=chunk_no("start_s", bucket_seconds))
    return (found.filter(F.col("n") >= min_run)
            .select(*keys_of(by), F.col("start_s").alias("t"), F.lit("scene").alias("source"),
                    F.least(F.lit(1.0), F.col("n") / 6.0).alias("strength"), F.col("n").alias("short_scenes")))
