"""Interval joins without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_no, keys_of, unnest


def dyadic(low: Column, high: Column) -> Column:
    """Cells low..high as aligned ranges (level, place): cells place * 2^level up to, but not including, (place + 1) * 2^level.

    On its way up the levels, the range loses an odd cell on its left and an even one on its right, so n cells make
    2 * log2(n) ranges at most. An empty array where low > high.
    """
    shift = lambda x, by: F.call_function("shiftright", x, by)
    levels = F.sequence(F.lit(0), F.coalesce(F.ceil(F.log2((high - low + 1).cast("double"))), F.lit(0)).cast("int"))

    def at(level):
        left, right = -shift(-low, level), shift(high + 1, level) - 1
        here = lambda place: F.struct(level.alias("level"), place.alias("place"))
        takes_left = (left <= right) & (F.pmod(left, F.lit(2)) == 1)
        from_left = F.when(takes_left, left + 1).otherwise(left)
        takes_right = (from_left <= right) & (F.pmod(right, F.lit(2)) == 0)
        return F.array_compact(F.array(F.when(takes_left, here(left)), F.when(takes_right, here(right))))

    return F.when(low <= high, F.flatten(F.transform(levels, at)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, by, t: str, start: str, end: str,
                        width: float = 8.0) -> DataFrame:
    """Pairs with start <= t <= end (closed at both ends) per key.

    Time is cut into cells of `width` seconds. An interval becomes aligned ranges of cells (`dyadic`), a few rows however long it
    is; a point looks its cell up at every level that some interval has (a scalar subquery finds these). It is an
    equi join on (key, level, place) whose hot places adaptive execution can split; ranges of an interval do not
    overlap, so every pair comes out once.
    """
    keys = keys_of(by)
    ranges = unnest(intervals.filter(F.col(start) <= F.col(end)), intervals.columns, dyadic(chunk_no(start, width), chunk_no(end, width)), "_r")
    ranges = ranges.select(*intervals.columns, "_r.level", "_r.place").withColumnsRenamed({"level": "_level", "place": "_place"})
    levels = ranges.agg(F.collect_set("_level")).scalar()
    p = unnest(points.withColumn("_cell", chunk_no(t, width)), [*points.columns, "_cell"], levels, "_level")
    p = p.withColumn("_place", F.call_function("shiftright", F.col("_cell"), F.col("_level"))).drop("_cell")
    return (p.join(ranges, [*keys, "_level", "_place"])
            .filter(F.col(t).between(F.col(start), F.col(end))).drop("_level", "_place"))
