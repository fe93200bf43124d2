"""Detections of a clip -> ball, ball path, key player."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center_x, center_y
from ..functions.ordered import CHUNK, chunk_no, keys_of, with_halo, with_key_row

# Class ids used when a model names no class of that role.
DEFAULT_CLASSES = {"player": [0], "ball": [32]}


def resolve_classes(names: DataFrame, defaults: dict | None = None, *, by="model_id") -> DataFrame:
    """(model, class_id, name) -> (model, role, class_id); a role no name matches gets the default ids."""
    keys = keys_of(by)
    defaults = {**DEFAULT_CLASSES, **(defaults or {})}
    low = F.lower("name")
    role = (F.when(F.contains(low, F.lit("ball")), "ball")
            .when(F.contains(low, F.lit("player")) | F.contains(low, F.lit("keeper")), "player"))
    named = names.withColumn("role", role)
    found = named.groupBy(*keys).agg(*[F.max(F.coalesce(F.col("role") == r, F.lit(False))).alias(r) for r in defaults])
    spare = F.flatten(F.array(*[
        F.when(F.col(r), F.array().cast("array<struct<role:string,class_id:bigint>>")).otherwise(
            F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).cast("long").alias("class_id")) for i in ids]))
        for r, ids in defaults.items()]))
    fallback = found.select(*keys, F.explode(spare).alias("_f")).select(*keys, "_f.role", "_f.class_id")
    return (named.filter(F.col("role").isNotNull())
            .select(*keys, "role", F.col("class_id").cast("long").alias("class_id")).unionByName(fallback))


def best_ball(dets: DataFrame, classes: DataFrame | None = None, *, by="clip_id") -> DataFrame:
    """Most confident ball per frame (first on ties); any detection of the dedicated model (`model` = 'ball') wins.

    `classes` (class_id of role ball) restricts detections of the main model. Class ids belong to a model: where both
    tables have a `model_id`, they are matched per model.
    """
    dedicated = F.col("model") == "ball"
    if classes is not None:
        keys = [c for c in ("model_id", "class_id") if c in dets.columns and c in classes.columns]
        balls = classes.filter(F.col("role") == "ball").select(*keys).distinct()
        dets = (dets.join(balls.withColumn("_ball", F.lit(True)), keys, "left")
                .filter(dedicated | F.col("_ball")).drop("_ball"))
    order = F.struct(dedicated.cast("int").alias("m"), F.col("conf").alias("c"), (-F.col("det_ord")).alias("o"))
    box = F.struct(center_x().alias("ball_x"), center_y().alias("ball_y"), F.col("conf").alias("conf"), F.col("model").alias("model"))
    return (dets.groupBy(*keys_of(by), "frame").agg(F.max_by(box, order).alias("_b"))
            .select(*keys_of(by), "frame", "_b.ball_x", "_b.ball_y", "_b.conf", "_b.model"))


def interpolate_ball(ball: DataFrame, *, max_gap: int = 8, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Linear fill between detections 2 to `max_gap` frames apart; longer gaps stay open."""
    keys = keys_of(by)
    rows = with_halo(ball, by, "frame", size=max(chunk, max_gap), after=max_gap)
    step = Window.partitionBy(*keys, "_chunk").orderBy("frame")
    rows = (rows.withColumn("_n", F.lead(F.struct("frame", "ball_x", "ball_y")).over(step)).filter("_own")
            .withColumn("_gap", F.col("_n.frame") - F.col("frame")))
    fill = F.when(F.col("_gap").between(2, max_gap), F.sequence(F.lit(0).cast("long"), F.col("_gap") - 1)).otherwise(
        F.array(F.lit(0).cast("long")))
    part = F.col("_k") / F.col("_gap")
    along = lambda c: F.when(F.col("_k") > 0, F.col(c) + part * (F.col(f"_n.{c}") - F.col(c))).otherwise(F.col(c))
    return (rows.withColumn("_k", F.explode(fill))
            .select(*keys, (F.col("frame") + F.col("_k")).alias("frame"), along("ball_x").alias("ball_x"), along("ball_y").alias("ball_y"),
                    (F.col("_k") > 0).alias("filled")))


def ball_holders(players: DataFrame, ball: DataFrame, clips: DataFrame, *, tail: float = 0.6, by="clip_id") -> DataFrame:
    """Player nearest to the detected ball in each frame from `int(tail * n_frames)` on.

    Clips of unknown length take part with all frames.
    """
    keys = keys_of(by)
    start = (F.coalesce("n_frames", F.lit(0)) * F.lit(float(tail))).cast("int")
    late = with_key_row(ball, clips.select(*keys, "n_frames"), by, bucket=chunk_no("frame"), how="left").filter(F.col("frame") >= start)
    dx, dy = F.col("cx") - F.col("ball_x"), F.col("cy") - F.col("ball_y")
    near = F.struct((dx * dx + dy * dy).alias("d2"), F.col("det_ord"))
    return (players.join(late.select(*keys, "frame", "ball_x", "ball_y"), [*keys, "frame"])
            .groupBy(*keys, "frame").agg(F.min_by("track_id", near).alias("track_id")))


def _votes(holders: DataFrame, keys) -> DataFrame:
    return holders.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("votes"), F.min("frame").alias("since"))




def _most(value: str, votes="votes", since="since"):
    return F.max_by(value, F.struct(F.col(votes).alias("v"), (-F.col(since)).alias("s")))


def key_player(players: DataFrame, ball: DataFrame, clips: DataFrame, *, tail: float = 0.6, by="clip_id") -> DataFrame:
    """Player most often nearest to the ball late in the clip."""
    keys = keys_of(by)
    votes = _votes(ball_holders(players, ball, clips, tail=tail, by=by), keys)
    return votes.groupBy(*keys).agg(_most("track_id").alias("key_track_id"), F.max("votes").alias("votes"))


def key_player_possession(players: DataFrame, ball: DataFrame, clips: DataFrame, teams: DataFrame, *,
                          tail: float = 0.6, by="clip_id") -> DataFrame:
    """Key player of the attacking team: the team most often nearest to the ball, then its most voted player.

    Without team information for any voted player this is `key_player`.
    """
    keys = keys_of(by)
    votes = _votes(ball_holders(players, ball, clips, tail=tail, by=by), keys)
    votes = votes.join(teams.select(*keys, "track_id", "team"), [*keys, "track_id"], "left").withColumn(
        "team", F.coalesce("team", F.lit(-1)))
    per_team = votes.groupBy(*keys, "team").agg(
        F.sum("votes").alias("team_votes"), F.min("since").alias("team_since"),
        F.max(F.struct("votes", (-F.col("since")).alias("ns"), "track_id")).alias("best"))
    known = F.col("team") != -1
    lead = F.struct(F.col("team_votes").alias("v"), (-F.col("team_since")).alias("s"))
    return (per_team.groupBy(*keys).agg(
        F.max_by("team", F.when(known, lead)).alias("attacking_team"),
        F.max_by("best", F.when(known, lead)).alias("_of_team"), F.max("best").alias("_any"))
        .select(*keys, F.coalesce("_of_team.track_id", "_any.track_id").alias("key_track_id"), "attacking_team"))
