"""Virtual camera for another aspect ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK, carry_last, chunk_no, ema, keys_of, with_key_row, with_position


def crop_width(aspect: str):
    """Crop width for an aspect such as '9:16', at most the frame width."""
    w, h = (int(p) for p in aspect.split(":"))
    return F.least(F.bround(F.col("height") * w / h).cast("long"), F.col("width").cast("long"))


def letterbox(clips: DataFrame, *, width: int = 1080, height: int = 1920) -> DataFrame:
    """Whole picture in a frame of another shape: size of the scaled picture and its place between the bars."""
    w = F.least(F.lit(width), F.round(F.lit(height) * F.col("width") / F.col("height")).cast("int"))
    h = F.least(F.lit(height), F.round(F.lit(width) * F.col("height") / F.col("width")).cast("int"))
    rows = clips.withColumn("scaled_w", w).withColumn("scaled_h", h)
    return rows.withColumns({"pad_x": F.floor((width - F.col("scaled_w")) / 2).cast("int"), "pad_y": F.floor((height - F.col("scaled_h")) / 2).cast("int")})


def focus_track(frames: DataFrame, players: DataFrame, ball_path: DataFrame, *, by="clip_id") -> DataFrame:
    """Frame focus x: the ball, else the mean of all players; null if the frame has neither."""
    keys = [*keys_of(by), "frame"]
    rest = [c for c in frames.columns if c not in keys]
    mean = players.groupBy(*keys).agg(F.avg("cx").alias("_mean"))
    return (frames.join(ball_path.select(*keys, "ball_x"), keys, "left").join(mean, keys, "left")
            .select(*keys, *rest, F.coalesce("ball_x", "_mean").alias("focus")))


def camera_path(frames: DataFrame, players: DataFrame, ball_path: DataFrame, clips: DataFrame, *,
                aspect: str = "9:16", alpha: float = 0.85, mode: str = "action_track", by="clip_id",
                chunk: int = CHUNK, dense: bool = True) -> DataFrame:
    """Smoothed centre and left edge of the crop per frame. Modes: action_track, center.

    A frame without focus keeps the one before, or the frame centre at the start of a clip. Frame numbers without gaps are taken as they
    are, and gaps raise an error; with `dense=False` frames are numbered first, so every kept frame counts as the next one.
    """
    keys = keys_of(by)
    size = clips.select(*keys, "width", "height")
    sized = with_key_row(frames.select(*keys, "frame"), size, by, bucket=chunk_no("frame", chunk))
    if mode == "center":
        rows = sized.withColumn("cx", F.col("width") / 2)
    elif mode == "action_track":
        focus = focus_track(sized, players, ball_path, by=by)
        held = carry_last(focus, by, ["frame"], "focus", bucket=chunk_no("frame", chunk), name="focus")
        rows = held.withColumn("focus", F.coalesce("focus", F.col("width") / 2))
        if not dense:
            rows = with_position(rows, by, ["frame"], bucket=chunk_no("frame", chunk), name="_pos")
        rows = ema(rows, by, "frame" if dense else "_pos", {"focus": "cx"}, keep=alpha)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    half = F.col("crop_w") / 2
    return (rows.withColumn("crop_w", crop_width(aspect))
            .withColumn("cx", F.least(F.greatest(F.col("cx"), half), F.col("width") - half))
            .select(*keys, "frame", "cx", F.bround(F.col("cx") - half).cast("long").alias("x0"), "crop_w"))
