"""Geometry of analyst graphics (spotlight, zone, ball trail, motion arrow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import truncate
from ..functions.ordered import CHUNK, chunk_no, keys_of, unnest_numbered, with_halo, with_position
from .stats import key_points

# Fixed values, in pixels: ellipse offset and axes, zone reach and half height.
SPOT_DROP, SPOT_AXES = 30, (46, 18)
ZONE_REACH, ZONE_HALF = 220, 70
TRAIL_WIDTH = 4


def key_path(players: DataFrame, key: DataFrame, *, by="clip_id") -> DataFrame:
    """Position of the key player per frame (the last detection of a frame counts)."""
    return (key_points(players, key, by=by).groupBy(*keys_of(by), "frame")
            .agg(F.max_by(F.struct("cx", "cy"), "det_ord").alias("_c")).select(*keys_of(by), "frame", "_c.cx", "_c.cy"))


def telestration_geometry(players: DataFrame, key: DataFrame, *, by="clip_id") -> DataFrame:
    """Spotlight ellipse and danger zone per key-player frame, whole pixels."""
    x, y = truncate(F.col("cx")), truncate(F.col("cy"))
    return key_path(players, key, by=by).select(
        *keys_of(by), "frame", x.alias("spot_x"), (y + SPOT_DROP).alias("spot_y"),
        F.lit(SPOT_AXES[0]).alias("spot_rx"), F.lit(SPOT_AXES[1]).alias("spot_ry"),
        x.alias("zone_x"), y.alias("zone_y"), (x + ZONE_REACH).alias("zone_far_x"),
        (y - ZONE_HALF).alias("zone_top_y"), (y + ZONE_HALF).alias("zone_bottom_y"))


def ball_trail(ball_path: DataFrame, *, n: int = 18, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Segments of the trail behind the ball: the last n ball points up to each ball frame, with line width."""
    keys = keys_of(by)
    rows = with_position(ball_path, by, ["frame"], bucket=chunk_no("frame", chunk), name="_pos")
    rows = with_halo(rows, by, "_pos", size=max(chunk, n), before=n - 1)
    last = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("_pts", F.collect_list(F.struct("ball_x", "ball_y")).over(last)).filter("_own")
    rows = rows.withColumn("_n", F.size("_pts")).filter(F.col("_n") > 1)
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    at = lambda i, c: truncate(F.element_at("_pts", i)[c])
    i = F.col("segment")
    return rows.select(*keys, "frame", i.cast("long").alias("segment"), at(i, "ball_x").alias("x0"), at(i, "ball_y").alias("y0"),
                       at(i + 1, "ball_x").alias("x1"), at(i + 1, "ball_y").alias("y1"),
                       F.greatest(F.lit(1), truncate(TRAIL_WIDTH * i / F.col("_n"))).alias("thickness"))


def motion_path(path: DataFrame, frames: DataFrame, *, back: int = 30, min_points: int = 5, smooth: bool = True,
                by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Points of the key player in the last `back` frames, for every frame of the clip that has enough of them.

    Smoothed by a box of max(1, n // 6) points, mirrored at the ends without repeating the end point.
    """
    keys = keys_of(by)
    rows = frames.select(*keys, "frame").join(path.select(*keys, "frame", "cx", "cy"), [*keys, "frame"], "left")
    rows = with_halo(rows, by, "frame", size=max(chunk, back), before=back)
    near = Window.partitionBy(*keys, "_chunk").orderBy("frame").rangeBetween(-back, 0)
    point = F.when(F.col("cx").isNotNull(), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))
    rows = (rows.withColumn("_pts", F.collect_list(point).over(near)).filter("_own")
            .withColumn("_n", F.size("_pts")).filter(F.col("_n") >= min_points))
    if smooth:
        k = F.greatest(F.lit(1), F.floor(F.col("_n") / 6).cast("int"))
        top = 2 * (F.col("_n") - 1)

        def mirrored(j):
            j = F.abs(j)
            return F.when(j >= F.col("_n"), top - j).otherwise(j)

        def box(i, c):
            taps = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.get("_pts", mirrored(i - F.floor(k / 2).cast("int") + o))[c])
            return F.aggregate(taps, F.lit(0.0), lambda a, v: a + v) / k

        rows = rows.withColumn("_pts", F.transform(
            F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(box(i, "x").alias("x"), box(i, "y").alias("y"))))
    return unnest_numbered(rows, [*keys, "frame"], F.col("_pts"), "point", "_p").select(*keys, "frame", "point", "_p.x", "_p.y")
