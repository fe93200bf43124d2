"""Camera calibration: keypoint matching, smoothing of homographies, pitch coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import pitch_landmarks
from ..functions.geometry import project
from ..functions.ordered import CHUNK, carry_last, chunk_no, ema, keys_of, with_position


def keypoint_matches(kps: DataFrame, *, conf: float = 0.5, min_points: int = 4, by="clip_id") -> DataFrame:
    """Keypoints (kp_idx, x, y, conf) paired with their pitch landmark; frames with too few are dropped."""
    marks = kps.sparkSession.createDataFrame(
        pitch_landmarks(), "kp_idx int, name string, px double, py double")
    # 17 landmarks: a fixed-size side, safe to broadcast whatever the data
    seen = (kps.filter((F.col("conf") >= conf) & (F.col("x") + F.col("y") > 0))
            .join(F.broadcast(marks), "kp_idx"))
    # a frame has one row per keypoint channel at most
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys_of(by), "frame"))
    return seen.withColumn("n_points", n).filter(F.col("n_points") >= min_points)


def carry_forward(h: DataFrame, *, every: int = 1, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Last solved map up to each frame; only every `every`-th frame is looked at."""
    sampled = h.withColumn("h", F.when(F.col("frame") % every == 0, F.col("h"))) if every > 1 else h
    return carry_last(sampled, by, ["frame"], "h", bucket=chunk_no("frame", chunk), name="h")


def smooth_homography(h: DataFrame, *, s: float = 0.8, every: int = 1, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """h = s * last + (1 - s) * h on sampled solved frames, carried to all others."""
    keys = keys_of(by)
    solved = h.filter(F.col("h").isNotNull() & (F.col("frame") % every == 0))
    solved = with_position(solved, by, ["frame"], bucket=chunk_no("frame", chunk), name="_pos")
    solved = solved.select(*keys, "frame", "_pos", *[F.col("h")[i].alias(f"_h{i}") for i in range(9)])
    smooth = ema(solved, by, "_pos", {f"_h{i}": f"_e{i}" for i in range(9)}, keep=s)
    smooth = smooth.select(*keys, "frame", F.array(*[F.col(f"_e{i}") for i in range(9)]).alias("h"))
    rows = h.drop("h").join(smooth, [*keys, "frame"], "left")
    return carry_last(rows, by, ["frame"], "h", bucket=chunk_no("frame", chunk), name="h")


def to_pitch(points: DataFrame, homography: DataFrame, *, x: str = "cx", y: str = "cy", by="clip_id") -> DataFrame:
    """Pitch coordinates px, py in metres of image points; null where the frame has no usable map."""
    keys = [*keys_of(by), "frame"]
    maps = homography.filter(F.col("h").isNotNull()).select(*keys, "h")
    return (points.join(maps, keys, "left").withColumn("_p", project(F.col("h"), F.col(x), F.col(y)))
            .select(*points.columns, "_p.px", "_p.py"))


def calib_coverage(homography: DataFrame, *, by="clip_id") -> DataFrame:
    """Share of frames with a map."""
    return homography.groupBy(*keys_of(by)).agg(
        F.avg(F.col("h").isNotNull().cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_frames"))
