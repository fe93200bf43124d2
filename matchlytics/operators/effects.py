"""Cut lists, slow motion, freeze frames: times only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import keys_of

# Fixed values, in seconds: shortest clip for slow motion, guard at both ends, shortest window.
MIN_CLIP, EDGE, MIN_WINDOW = 4.0, 0.4, 0.5


def cut_list(moments: DataFrame, *, by="match_id") -> DataFrame:
    """Chronological cuts of a match: index, file name, duration (0.5 s at least), key time inside the clip.

    Moments per match are bounded by the top-k that made them, so numbering them in one window is safe.
    """
    keys = keys_of(by)
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "start_s")) - 1
    return (moments.withColumn("clip_no", no.cast("long"))
            .withColumn("name", F.format_string("clip_%02d_%s", "clip_no", "kind"))
            .withColumn("duration", F.greatest(F.lit(0.5), F.col("end_s") - F.col("start_s")))
            .withColumn("key_t", F.greatest(F.lit(0.0), F.col("t") - F.col("start_s"))))


def slowmo_window(clips: DataFrame, *, factor: float = 0.4, window: float = 2.5) -> DataFrame:
    """Adds slow_from, slow_to and factor; null where the clip is too short or has no room."""
    start = F.least(F.greatest(F.lit(EDGE), F.col("key_t") - window / 2), F.col("duration") - EDGE - 0.1)
    rows = clips.withColumn("_s", start).withColumn("_e", F.least(F.col("_s") + window, F.col("duration") - EDGE))
    fits = (F.col("duration") >= MIN_CLIP) & (F.col("_e") - F.col("_s") >= MIN_WINDOW)
    return (rows.withColumn("slow_from", F.when(fits, F.col("_s"))).withColumn("slow_to", F.when(fits, F.col("_e")))
            .withColumn("factor", F.when(fits, F.lit(float(factor)))).drop("_s", "_e"))


def finished_length(clips: DataFrame, *, factor: float = 0.4, window: float = 2.5, freeze: float = 1.2) -> DataFrame:
    """`duration` of the rendered segment: the cut, what slow motion adds to it, and the freeze frame."""
    rows = slowmo_window(clips, factor=factor, window=window)
    extra = F.coalesce((F.col("slow_to") - F.col("slow_from")) * (1 / F.col("factor") - 1), F.lit(0.0))
    return rows.withColumn("duration", F.col("duration") + extra + F.lit(float(freeze))).select(*clips.columns)


def time_remap(events: DataFrame, windows: DataFrame, *, by="clip_id", t: str = "event_t") -> DataFrame:
    """Adds out_t, the time of an event after slow motion, and the new clip length."""
    keys = keys_of(by)
    a, b, f, x = F.col("slow_from"), F.col("slow_to"), F.col("factor"), F.col(t)
    extra = (b - a) * (1 / f - 1)
    mapped = F.when(a.isNull() | (x < a), x).when(x < b, a + (x - a) / f).otherwise(x + extra)
    return (events.join(windows.select(*keys, "duration", "slow_from", "slow_to", "factor"), keys)
            .withColumn("out_t", mapped)
            .withColumn("out_duration", F.col("duration") + F.coalesce(extra, F.lit(0.0)))
            .select(*events.columns, "out_t", "out_duration"))


def freeze_plan(clips: DataFrame, *, seconds: float = 1.2, fps: float = 30.0) -> DataFrame:
    """Adds the time of the frozen frame and the length of the freeze."""
    grab = F.least(F.greatest(F.lit(0.0), F.col("key_t")), F.greatest(F.lit(0.0), F.col("duration") - 0.1))
    return clips.withColumns({"grab_t": grab, "freeze_s": F.lit(float(seconds)),
                              "freeze_frames": F.lit(int(seconds * fps))})
