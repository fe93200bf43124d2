"""Ordered analytics that never need all rows of one key in one task.

A plain window partitioned by match or clip sends the whole key to one task. Here each key is cut into
chunks along its order; the ordered work runs per (key, chunk), and only one small summary row per chunk
is ordered per key. Two shapes cover every operator of the package:

* bounded reach (moving windows, short gaps): each row is copied into the few chunks it can influence
  (`with_halo`), so a chunk is complete by itself;
* unbounded reach (row numbers, running sums, carried values, runs): chunk results are shifted by the
  summary of the chunks before (`with_position`, `running_sum`, `previous`, `following`, `carry_last`,
  `islands`).

`bucket` is a column that does not decrease along `order`, e.g. `chunk_no("frame")`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def keys_of(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_no(pos, size: float = CHUNK) -> Column:
    return F.floor(_col(pos) / F.lit(size)).cast("long")


def unnest(df: DataFrame, keep, array: Column, name: str) -> DataFrame:
    """One row per element of an array made by a costly expression.

    A plain explode() would get a filter on the array's size in front of it and so work the expression out
    twice; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def unnest_numbered(df: DataFrame, keep, array: Column, no: str, name: str) -> DataFrame:
    """`unnest` with the 0-based place of the element."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(no, name)).filter(F.col(name).isNotNull())
    return rows.withColumn(no, F.col(no).cast("long"))


def _spread(rows: DataFrame, keys, chunk: str = "_b") -> DataFrame:
    """Partitions rows by (key, chunk).

    Asked for explicitly: rows that come partitioned by the key alone (from a join on it, say) would satisfy a
    window over (key, chunk) as they are, and leave a hot key in one task. Spark plans no second exchange
    where the rows are already partitioned this way.
    """
    return rows.repartition(*keys, chunk)


def _per_chunk(keys, order):
    return Window.partitionBy(*keys, "_b").orderBy(*order)


def _attach(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    # Both sides are keyed by (key, chunk): the big side keeps the partitioning of its window.
    return df.join(summary, [*keys, "_b"], "left")


def with_key_row(df: DataFrame, dim: DataFrame, by, *, bucket: Column, how: str = "inner", chunk: str | None = None) -> DataFrame:
    """Joins the one row per key of `dim` to all rows of the key, as a join on (key, chunk).

    `dim` is copied to the chunks that its key really has: one for most keys, many for a hot one, whose rows
    then spread over as many tasks. (Adaptive execution splits hot join keys only where both sides come
    straight from an exchange.) `chunk` names a column to keep the chunk number in.
    """
    keys = keys_of(by)
    rows = df.withColumn("_b", bucket)
    copies = rows.select(*keys, "_b").distinct().join(dim, keys)
    out = rows.join(copies, [*keys, "_b"], how)
    return out.withColumnRenamed("_b", chunk) if chunk else out.drop("_b")


def with_position(df: DataFrame, by, order, *, bucket: Column, name: str = "pos",
                  total: str | None = None) -> DataFrame:
    """0-based row number per key, and optionally the row count of the key."""
    keys = keys_of(by)
    rows = df.withColumn("_b", bucket)
    key = Window.partitionBy(*keys)
    ahead = key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"),
                       F.sum("_n").over(key).alias("_tot")))
    out = _attach(_spread(rows, keys).withColumn("_rn", F.row_number().over(_per_chunk(keys, order))), offsets, keys)
    cols = [*df.columns, (F.col("_off") + F.col("_rn") - 1).cast("long").alias(name)]
    return out.select(*cols, *([F.col("_tot").alias(total)] if total else []))


def running_sum(df: DataFrame, by, order, cols: dict[str, Column], *, bucket: Column) -> DataFrame:
    """Running totals (current row included) of integer expressions, `cols` = new name -> expression."""
    keys = keys_of(by)
    rows = df.withColumn("_b", bucket)
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(*[F.sum(e).alias(f"_s_{n}") for n, e in cols.items()])
    sums = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}")
                                      for n in cols])
    local = _per_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _spread(rows, keys)
    for n, e in cols.items():
        rows = rows.withColumn(f"_l_{n}", F.sum(e).over(local))
    out = _attach(rows, sums, keys)
    return out.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in cols])


def _neighbour(df, by, order, cols, bucket, prefix, step, edge, shift):
    keys = keys_of(by)
    rows = df.withColumn("_b", bucket).withColumn("_row", F.struct(*cols))
    entry = (rows.groupBy(*keys, "_b").agg(edge("_row", F.struct(*order)).alias("_edge"))
             .select(*keys, "_b", shift("_edge").over(Window.partitionBy(*keys).orderBy("_b")).alias("_entry")))
    rows = _spread(rows, keys).withColumn("_near", step("_row").over(_per_chunk(keys, order)))
    out = _attach(rows, entry, keys).withColumn("_near", F.coalesce("_near", "_entry"))
    return out.select(*df.columns, *[F.col(f"_near.{c}").alias(prefix + c) for c in cols])


def previous(df: DataFrame, by, order: list[str], cols: list[str], *, bucket: Column,
             prefix: str = "prev_") -> DataFrame:
    """Values of the row before, per key in `order`."""
    return _neighbour(df, by, order, cols, bucket, prefix, F.lag, F.max_by, F.lag)


def following(df: DataFrame, by, order: list[str], cols: list[str], *, bucket: Column,
              prefix: str = "next_") -> DataFrame:
    """Values of the row after, per key in `order`."""
    return _neighbour(df, by, order, cols, bucket, prefix, F.lead, F.min_by, F.lead)


def carry_last(df: DataFrame, by, order: list[str], col: str, *, bucket: Column, name: str) -> DataFrame:
    """Last non-null value of `col` up to and including the row."""
    keys = keys_of(by)
    rows = df.withColumn("_b", bucket)
    known = F.col(col).isNotNull()
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # max_by skips rows whose ordering is null, so only known values take part
    entry = (rows.groupBy(*keys, "_b").agg(F.max_by(col, F.when(known, F.struct(*order))).alias("_edge"))
             .select(*keys, "_b", F.last("_edge", ignorenulls=True).over(ahead).alias("_entry")))
    local = _per_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _spread(rows, keys).withColumn("_near", F.last(col, ignorenulls=True).over(local))
    out = _attach(rows, entry, keys).withColumn("_near", F.coalesce("_near", "_entry"))
    return out.select(*[c for c in df.columns if c != name], F.col("_near").alias(name))


def over_pairs(df: DataFrame, by, order: list[str], cols: list[str], values, *, bucket: Column, const=()) -> DataFrame:
    """Aggregates over pairs of consecutive rows of a key, in one pass and without a join.

    `values(before, row)` gets two structs of `cols` and gives {name: ("sum" | "max", expression)}. A chunk keeps
    its aggregates, its first and its last row; per key only the pairs across chunk borders are added to them.
    Keys with one row come out with nulls. `const` names entries of `cols` that are the same in all rows of a key.
    """
    keys = keys_of(by)
    rows = df.select(*keys, bucket.alias("_b"), F.struct(*order).alias("_at"), F.struct(*cols).alias("_row"))
    rows = _spread(rows, keys).withColumn("_prev", F.lag("_row").over(_per_chunk(keys, ["_at"])))
    inside = values(F.col("_prev"), F.col("_row"))
    add = {"sum": F.sum, "max": F.max}
    chunks = rows.groupBy(*keys, "_b").agg(
        *[add[kind](F.when(F.col("_prev").isNotNull(), v)).alias(n) for n, (kind, v) in inside.items()],
        F.min_by("_row", "_at").alias("_first"), F.max_by("_row", "_at").alias("_last"))
    chunks = chunks.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    border = values(F.col("_prev"), F.col("_first"))

    def both(n, kind, v):
        edge = F.when(F.col("_prev").isNotNull(), v)
        if kind == "max":
            return F.max(F.greatest(F.col(n), edge)).alias(n)
        known = F.coalesce(F.col(n), edge).isNotNull()
        return F.sum(F.when(known, F.coalesce(F.col(n), F.lit(0)) + F.coalesce(edge, F.lit(0)))).alias(n)

    same = [F.max(F.col("_first")[c]).alias(c) for c in const]
    return chunks.groupBy(*keys).agg(*[both(n, kind, v) for n, (kind, v) in border.items()], *same)


def last_rows(df: DataFrame, by, order: str, n: Column, *, bucket: Column) -> DataFrame:
    """The last n rows of each key, where `n` is a column that is constant per key and null means all.

    Each chunk keeps its own last n first, so a key brings n rows per chunk together.
    """
    keys = keys_of(by)
    late = lambda part: F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.desc(order)))
    rows = df.withColumn("_n", n).withColumn("_b", bucket)
    rows = _spread(rows, keys).withColumn("_r", late("_b")).filter(F.col("_n").isNull() | (F.col("_r") <= F.col("_n")))
    rows = rows.withColumn("_lane", F.when(F.col("_n").isNull(), F.col("_b")).otherwise(-1))
    rows = rows.withColumn("_r", late("_lane")).filter(F.col("_n").isNull() | (F.col("_r") <= F.col("_n")))
    return rows.select(*df.columns)


def with_halo(df: DataFrame, by, pos, *, size: float, before: float = 0, after: float = 0) -> DataFrame:
    """Copies each row into every chunk it can influence: `_chunk`, and `_own` for the chunk it belongs to.

    A chunk then holds its own rows, the `before` positions ahead of it and the `after` positions behind it.
    The result is partitioned by (key, chunk).
    """
    p = _col(pos)
    low = F.greatest(F.lit(0), chunk_no(p - F.lit(after), size))
    high = F.greatest(F.lit(0), chunk_no(p + F.lit(before), size))
    return (_spread(df.withColumn("_chunk", F.explode_outer(F.sequence(low, high))), keys_of(by), "_chunk")
            .withColumn("_own", F.col("_chunk") == F.greatest(F.lit(0), chunk_no(p, size))))


def islands(df: DataFrame, by, pos: str, best: Column, *, size: int = CHUNK, chunked: str | None = None) -> DataFrame:
    """Runs of consecutive integer positions: first and last position, row count and the greatest `best`.

    Runs are built per chunk; only runs that touch a chunk border (two per chunk at most) are stitched per key.
    `chunked` names a column that already holds chunk_no(pos, size): rows partitioned by it stay where they are.
    """
    keys = keys_of(by)
    rows = df.withColumn("_best", best)
    rows = _spread(rows.withColumn("_b", chunk_no(pos, size)), keys) if chunked is None else rows.withColumnRenamed(chunked, "_b")
    rows = rows.withColumn("_run", F.col(pos) - F.row_number().over(_per_chunk(keys, [pos])))
    runs = rows.groupBy(*keys, "_b", "_run").agg(
        F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"),
        F.max("_best").alias("best"))
    border = (F.col("first") == F.col("_b") * size) | (F.col("last") == (F.col("_b") + 1) * size - 1)
    runs = runs.withColumn("_lane", F.when(border, F.lit(-1)).otherwise(F.col("_b")))
    lane = Window.partitionBy(*keys, "_lane").orderBy("first")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(lane) > 1, F.lit(True))
    runs = (runs.withColumn("_fresh", fresh.cast("int"))
            .withColumn("_no", F.sum("_fresh").over(lane.rowsBetween(Window.unboundedPreceding, 0))))
    return runs.groupBy(*keys, "_lane", "_no").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
        F.max("best").alias("best")).drop("_lane", "_no")


def runs(df: DataFrame, by, order: list[str], member: Column, first: list[str], *, bucket: Column) -> DataFrame:
    """Runs of consecutive rows along `order` for which `member` holds: `n` rows, and the columns `first` of the first of them.

    Runs are built per chunk. A chunk passes on its first and its last run only (or that there is none at its border), and
    these are stitched per key.
    """
    keys = keys_of(by)
    rows = df.select(*keys, bucket.alias("_b"), F.struct(*order).alias("_at"), F.struct(*first).alias("_row"), F.coalesce(member, F.lit(False)).alias("_in"))
    step = Window.partitionBy(*keys, "_b").orderBy("_at")
    rows = _spread(rows, keys).withColumns({
        "_no": F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(step.rowsBetween(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(step)})
    # a group is a row outside, if any, and the run behind it
    groups = rows.groupBy(*keys, "_b", "_no").agg(
        F.count_if("_in").alias("n"), F.min_by("_row", F.when(F.col("_in"), F.col("_at"))).alias("_row"),
        F.min(F.when(F.col("_in"), F.col("_at"))).alias("_at"), F.min("_rn").alias("_rn"), F.bool_or(~F.col("_in")).alias("_cut"))
    chunk = Window.partitionBy(*keys, "_b")
    groups = groups.withColumns({"_head": (F.col("_rn") == 1) & ~F.col("_cut"), "_tail": F.col("_no") == F.max("_no").over(chunk), "_low": F.col("_no") == F.min("_no").over(chunk)})
    groups = groups.withColumn("_lane", F.when(F.col("_low") | F.col("_tail"), F.lit(None)).otherwise(F.col("_b")))
    lane = Window.partitionBy(*keys, "_lane").orderBy("_b", "_no")
    joined = F.col("_lane").isNull() & F.col("_head") & F.lag("_tail").over(lane)
    groups = groups.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_id", F.sum("_new").over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    out = groups.groupBy(*keys, "_lane", "_id").agg(F.sum("n").alias("n"), F.min_by("_row", "_at").alias("_row"))
    return out.filter(F.col("n") > 0).select(*keys, "n", "_row.*")


def ema(df: DataFrame, by, pos: str, cols: dict[str, str], *, keep: float) -> DataFrame:
    """Exponential smoothing y = keep*y_before + (1-keep)*x along dense positions; the first y is x.

    Weights fall below 1e-17 after `reach` positions, so a chunk with that much halo gives the same doubles
    up to the last digits. Inside a chunk the recursion is a running sum of x scaled by keep^-k; `size` keeps
    that scale far from overflow. Gaps or repeats among the positions raise an error. `cols` = source column -> new name.
    """
    if keep <= 0:
        return df.select("*", *[F.col(c).alias(n) for c, n in cols.items()])
    keys = keys_of(by)
    if keep >= 1:
        start = df.groupBy(*keys).agg(*[F.min_by(c, pos).alias(n) for c, n in cols.items()])
        return df.join(start, keys)
    reach = math.ceil(17 / -math.log10(keep)) + 1
    rows = with_halo(df, by, pos, size=8 * reach, before=reach)
    step = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    gap = F.lag(pos).over(step) != F.col(pos) - 1
    rows = rows.withColumn("_k", F.when(gap, F.raise_error(F.concat(F.lit("positions are not dense at "), F.col(pos).cast("string")))).otherwise(F.row_number().over(step) - 1))
    up = F.pow(F.lit(float(keep)), -F.col("_k"))
    share = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - keep))
    total = step.rowsBetween(Window.unboundedPreceding, 0)
    for c, n in cols.items():
        rows = rows.withColumn(n, F.sum(F.col(c) * share * up).over(total) / up)
    return rows.filter("_own").select(*df.columns, *cols.values())
