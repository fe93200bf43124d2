"""Distances, speed and dribbles of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..functions.ordered import CHUNK, chunk_no, keys_of, last_rows, over_pairs, with_key_row
from .pitch import calib_coverage, to_pitch

# Metres that span the frame width without calibration, coverage needed for metric mode.
FRAME_SPAN_M = 60.0
MIN_COVERAGE = 0.5


def key_points(players: DataFrame, key: DataFrame, *, by="clip_id") -> DataFrame:
    """Detections of the clip's key player."""
    who = key.select(*keys_of(by), F.col("key_track_id").alias("track_id"))
    return players.join(who, [*keys_of(by), "track_id"])


def _with_mode(clips: DataFrame, homography: DataFrame | None, keys, metric: bool | None, by) -> DataFrame:
    """Clip dimension with `metric`: fixed, or true for clips with enough calibrated frames."""
    base = clips.select(*keys, "width", "fps")
    if metric is not None or homography is None:
        return base.withColumn("metric", F.lit(bool(metric)))
    cover = calib_coverage(homography, by=by).select(*keys, "coverage")
    return base.join(cover, keys, "left").withColumn("metric", F.coalesce(F.col("coverage") > MIN_COVERAGE, F.lit(False))).drop("coverage")


def _in_mode(points: DataFrame, homography: DataFrame | None, x: str, y: str, by) -> DataFrame:
    """Coordinates px, py to measure with: pitch metres in metric clips (points without map drop out), else pixels."""
    if homography is None:
        return points.withColumns({"px": F.col(x), "py": F.col(y)})
    rows = to_pitch(points, homography, x=x, y=y, by=by)
    flat = lambda pitch, image: F.when(F.col("metric"), F.col(pitch)).otherwise(F.col(image))
    return rows.withColumns({"px": flat("px", x), "py": flat("py", y)}).filter(F.col("px").isNotNull()).select(*points.columns, "px", "py")


_MODE = ["metric", "fps", "width"]


def _steps(before, row, max_jump: float, max_kmh: float, px_per_m: float | None):
    """Length in metres and speed of one step between two points (px, py, frame, metric, fps, width).

    In metric clips steps beyond `max_jump` metres count for neither; pixel clips have no speed.
    """
    d = distance(before["px"], before["py"], row["px"], row["py"])
    fps = F.when(F.coalesce(row["fps"], F.lit(0.0)) == 0, F.lit(30.0)).otherwise(row["fps"])
    speed = d / (F.greatest(F.lit(1), row["frame"] - before["frame"]) / fps) * 3.6
    scale = F.lit(float(px_per_m)) if px_per_m is not None else row["width"] / FRAME_SPAN_M
    real = row["metric"] & (d <= max_jump)
    return {"distance_m": ("sum", F.when(real, d).when(~row["metric"], d / scale)),
            "top_speed_kmh": ("max", F.when(real & (speed < max_kmh), speed))}


def _measure(points: DataFrame, order, by, chunk, *, max_jump: float = 12.0, max_kmh: float = 45.0,
             px_per_m: float | None = None) -> DataFrame:
    steps = lambda before, row: _steps(before, row, max_jump, max_kmh, px_per_m)
    return over_pairs(points, by, list(order), ["px", "py", "frame", *_MODE], steps, bucket=chunk_no("frame", chunk), const=["metric"])


def player_run(players: DataFrame, key: DataFrame, clips: DataFrame, homography: DataFrame | None = None, *,
               metric: bool | None = None, px_per_m: float | None = None, max_jump: float = 12.0,
               max_kmh: float = 45.0, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Distance and top speed of each clip's key player; 0 for clips whose player has fewer than two points."""
    keys, order = keys_of(by), ["frame", "det_ord"]
    who = key.select(*keys, F.col("key_track_id").alias("track_id")).join(_with_mode(clips, homography, keys, metric, by), keys)
    points = _in_mode(players.join(who, [*keys, "track_id"]), homography, "cx", "cy", by)
    path = _measure(points, order, by, chunk, max_jump=max_jump, max_kmh=max_kmh, px_per_m=px_per_m)
    zero = F.lit(0.0)
    return (who.select(*keys, "metric").join(path.drop("metric"), keys, "left")
            .select(*keys, F.coalesce("distance_m", zero).alias("sprint_distance_m"),
                    F.when(F.col("metric"), F.coalesce("top_speed_kmh", zero)).alias("top_speed_kmh")))


def ball_shot(ball_path: DataFrame, clips: DataFrame, homography: DataFrame | None = None, *, metric: bool | None = None,
              px_per_m: float | None = None, max_jump: float = 12.0, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Ball distance over the last int(fps // 2) points of its path.

    Metric clips use two points at least, before points without map drop out, and give null instead of 0; in
    pixel clips 0 points mean the whole path.
    """
    keys, bucket = keys_of(by), chunk_no("frame", chunk)
    half = F.floor(F.col("fps") / 2).cast("long")
    n = F.when(F.col("metric"), F.greatest(F.lit(2), half)).otherwise(F.nullif(half, F.lit(0)))
    rows = with_key_row(ball_path, _with_mode(clips, homography, keys, metric, by), by, bucket=bucket)
    points = _in_mode(last_rows(rows, by, "frame", n, bucket=bucket), homography, "ball_x", "ball_y", by)

    path = _measure(points, ["frame"], by, chunk, max_jump=max_jump, px_per_m=px_per_m)
    # a single point has no length: 0 in pixel clips, nothing in metric ones
    return path.select(*keys, F.when(F.col("metric"), F.nullif("distance_m", F.lit(0.0)))
                       .otherwise(F.coalesce("distance_m", F.lit(0.0))).alias("shot_distance_m"))


def player_measures(players: DataFrame, key: DataFrame, clips: DataFrame, homography: DataFrame | None = None, *,
                    px_per_m: float | None = None, cap: int = 6, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """`player_run` and `players_beaten` of every clip with a key player, reading players and key once.

    Key rows carry their pitch position, other rows their x relative to the key player of the frame; both are
    series per track, so one pass over pairs of rows measures all of them.
    """
    keys = keys_of(by)
    who = key.select(*keys, "key_track_id").join(_with_mode(clips, homography, keys, None, by), keys)
    rows = with_key_row(players, who, by, bucket=chunk_no("frame", chunk), chunk="_part")
    rows = rows.withColumn("_is", F.col("track_id") == F.col("key_track_id"))
    here = Window.partitionBy(*keys, "_part", "frame")
    own = F.when(F.col("_is"), F.struct("det_ord", "cx"))
    rows = rows.withColumn("rel", F.col("cx") - F.min(own).over(here)["cx"])
    if homography is None:
        rows = rows.withColumns({"px": F.col("cx"), "py": F.col("cy")})
    else:
        rows = to_pitch(rows, homography, by=by)
        flat = lambda pitch, image: F.when(F.col("metric"), F.col(pitch)).otherwise(F.col(image))
        rows = rows.withColumns({"px": flat("px", "cx"), "py": flat("py", "cy")})
    rows = rows.filter(F.when(F.col("_is"), F.col("px").isNotNull()).otherwise(F.col("rel").isNotNull()))

    def steps(before, row):
        measured = _steps(before, row, 12.0, 45.0, px_per_m)
        only = {n: (kind, F.when(row["_is"], v)) for n, (kind, v) in measured.items()}
        passed = ~row["_is"] & (before["rel"] < 0) & (row["rel"] >= 0)
        return {**only, "passed": ("max", passed.cast("int"))}

    tracks = over_pairs(rows, [*keys, "track_id"], ["frame", "det_ord"], ["px", "py", "frame", "rel", "_is", *_MODE], steps,
                        bucket=chunk_no("frame", chunk))
    zero = F.lit(0.0)
    total = tracks.groupBy(*keys).agg(F.max("distance_m").alias("_run"), F.max("top_speed_kmh").alias("_top"), F.sum("passed").alias("_n"))
    return (who.join(total, keys, "left").select(
        *keys, "key_track_id", "metric", F.coalesce("_run", zero).alias("sprint_distance_m"),
        F.when(F.col("metric"), F.coalesce("_top", zero)).alias("top_speed_kmh"),
        F.least(F.lit(cap), F.coalesce("_n", F.lit(0))).cast("long").alias("players_beaten")))


def pixel_distance(players: DataFrame, key: DataFrame, clips: DataFrame, *, px_per_m: float | None = None,
                   by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Path length of the key player in metres, from pixels."""
    return player_run(players, key, clips, px_per_m=px_per_m, by=by, chunk=chunk).drop("top_speed_kmh")


def pixel_shot(ball_path: DataFrame, clips: DataFrame, *, px_per_m: float | None = None, by="clip_id",
               chunk: int = CHUNK) -> DataFrame:
    """Ball distance of the last half second in metres, from pixels."""
    return ball_shot(ball_path, clips, px_per_m=px_per_m, by=by, chunk=chunk)


def metric_path(points: DataFrame, clips: DataFrame, *, max_jump: float = 12.0, max_kmh: float = 45.0,
                order=("frame",), by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Distance and top speed along pitch points (px, py); jumps beyond `max_jump` metres count for neither."""
    mode = _with_mode(clips, None, keys_of(by), True, by)
    rows = with_key_row(points.filter(F.col("px").isNotNull()), mode, by, bucket=chunk_no("frame", chunk))
    zero = F.lit(0.0)
    return _measure(rows, order, by, chunk, max_jump=max_jump, max_kmh=max_kmh).select(
        *keys_of(by), F.coalesce("distance_m", zero).alias("distance_m"), F.coalesce("top_speed_kmh", zero).alias("top_speed_kmh"))


def metric_distance(players: DataFrame, key: DataFrame, homography: DataFrame, clips: DataFrame, *,
                    max_jump: float = 12.0, max_kmh: float = 45.0, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Distance and top speed of the key player on the pitch, whatever the coverage."""
    return player_run(players, key, clips, homography, metric=True, max_jump=max_jump, max_kmh=max_kmh, by=by, chunk=chunk)


def metric_shot(ball_path: DataFrame, homography: DataFrame, clips: DataFrame, *, max_jump: float = 12.0,
                by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Ball distance of the last half second on the pitch, whatever the coverage; null when 0."""
    return ball_shot(ball_path, clips, homography, metric=True, max_jump=max_jump, by=by, chunk=chunk)


def players_beaten(players: DataFrame, key: DataFrame, *, cap: int = 6, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Distinct players that pass from behind the key player (x smaller) to level or ahead; at most `cap`."""
    keys = keys_of(by)
    own = (key_points(players, key, by=by).groupBy(*keys, "frame")
           .agg(F.min_by("cx", "det_ord").alias("_kx"), F.first("track_id").alias("_key")))
    others = (players.join(own, [*keys, "frame"]).filter(F.col("track_id") != F.col("_key"))
              .select(*keys, "track_id", "frame", "det_ord", (F.col("cx") - F.col("_kx")).alias("rel")))
    passed = lambda before, row: {"passed": ("max", ((before["rel"] < 0) & (row["rel"] >= 0)).cast("int"))}
    tracks = over_pairs(others, [*keys, "track_id"], ["frame", "det_ord"], ["rel"], passed, bucket=chunk_no("frame", chunk))
    count = tracks.groupBy(*keys).agg(F.sum("passed").alias("_n"))
    return (key.select(*keys).join(count, keys, "left")
            .select(*keys, F.least(F.lit(cap), F.coalesce("_n", F.lit(0))).cast("long").alias("players_beaten")))


def clip_stats(players: DataFrame, ball_path: DataFrame, key: DataFrame, clips: DataFrame,
               homography: DataFrame | None = None, *, px_per_m: float | None = None, by="clip_id",
               chunk: int = CHUNK) -> DataFrame:
    """One row per clip; metric when more than half of its frames are calibrated, else from pixels."""
    keys = keys_of(by)
    return (_with_mode(clips, homography, keys, None, by).select(*keys, "metric")
            .join(player_measures(players, key, clips, homography, px_per_m=px_per_m, by=by, chunk=chunk).drop("metric"), keys, "left")
            .join(ball_shot(ball_path, clips, homography, px_per_m=px_per_m, by=by, chunk=chunk), keys, "left")
            .select(*keys, "key_track_id", "metric", "sprint_distance_m", "top_speed_kmh", "shot_distance_m",
                    F.coalesce("players_beaten", F.lit(0)).cast("long").alias("players_beaten")))
