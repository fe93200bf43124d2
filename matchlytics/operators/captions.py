"""Caption lines and their schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK, chunk_no, keys_of, with_position
from ..functions.ranges import points_in_intervals
from ..functions.text import strip


def caption_lines(words: DataFrame, *, n: int = 4, by="clip_id", order=("turn", "pos"),
                  bucket=None) -> DataFrame:
    """Words of a clip in lines of n: text, start of the first and end of the last word; the rest is a short line.

    Words carry their own leading space, as speech recognition gives them. They are numbered in buckets, by default of up to 4096
    words of one turn, so that neither a clip nor a long turn is ordered in one task.
    """
    keys = keys_of(by)
    bucket = F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(order[:-1])], chunk_no(order[-1], 4096).alias("b")) if bucket is None else bucket
    rows = with_position(words, by, list(order), bucket=bucket, name="_no")
    rows = rows.withColumn("line_no", F.floor(F.col("_no") / n).cast("long"))
    lines = rows.groupBy(*keys, "line_no").agg(
        F.sort_array(F.collect_list(F.struct("_no", "word", "start_s", "end_s"))).alias("_w"))
    text = strip(F.array_join(F.transform("_w", lambda w: w["word"]), ""))
    return lines.select(*keys, "line_no", text.alias("text"), F.element_at("_w", 1)["start_s"].alias("start_s"),
                        F.element_at("_w", -1)["end_s"].alias("end_s"))


def caption_schedule(lines: DataFrame, *, by="clip_id", order: str = "line_no", chunk: int = CHUNK, numbered: bool = False) -> DataFrame:
    """Drawn captions: blank lines are skipped but keep their number; times with two decimals.

    `numbered` says that `order` already counts the lines of a clip from 0, as `caption_lines` makes it.
    """
    keys = keys_of(by)
    rows = lines.withColumn("draw_no", F.col(order)) if numbered else with_position(lines, by, [order], bucket=chunk_no(order, chunk), name="draw_no")
    text = strip(F.coalesce("text", F.lit("")))
    return rows.withColumn("text", text).filter(F.col("text") != "").select(
        *keys, "draw_no", "text", F.format_string("%.2f", "start_s").alias("from_s"),
        F.format_string("%.2f", "end_s").alias("to_s"))


def captions_at(times: DataFrame, lines: DataFrame, *, by="clip_id", t: str = "t", width: float = 4.0) -> DataFrame:
    """Lines on screen at each time; a line shows from its start to its end, both included."""
    return points_in_intervals(times, lines, by=by, t=t, start="start_s", end="end_s", width=width)


def signals_in_moments(signals: DataFrame, moments: DataFrame, *, by="match_id", width: float = 16.0) -> DataFrame:
    """Signals that fall into the padded window of a moment, both ends included."""
    windows = moments.select(*keys_of(by), F.col("t").alias("moment_t"), "start_s", "end_s", "kind")
    return points_in_intervals(signals, windows, by=by, t="t", start="start_s", end="end_s", width=width)


def round_robin(df: DataFrame, pool, *, by=("match_id", "kind"), order=("t",), bucket=None, name: str = "pick") -> DataFrame:
    """Takes the entries of a list in turn, counted per `by` in `order`.

    `pool` is a list, or a dict of lists by kind; kinds without entries use those of 'goal'. Without `bucket`
    each group is numbered in one window: only for groups of bounded size, such as the top moments of a match.
    """
    if bucket is None:
        turn = F.row_number().over(Window.partitionBy(*keys_of(by)).orderBy(*order)) - 1
        rows = df.withColumn("_turn", turn.cast("long"))
    else:
        rows = with_position(df, by, list(order), bucket=bucket, name="_turn")
    if isinstance(pool, dict):
        spare = pool.get("goal") or []
        entries = F.lit(spare).cast("array<string>")
        for kind, texts in pool.items():
            if texts:
                entries = F.when(F.col("kind") == kind, F.lit(texts)).otherwise(entries)
    else:
        entries = F.lit(list(pool)).cast("array<string>")
    n = F.size(entries)
    return rows.withColumn(name, F.when(n > 0, F.get(entries, (F.col("_turn") % n).cast("int")))).drop("_turn")
