"""Loudness envelope, rolling baseline, peaks (crowd-noise spikes)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK, chunk_no, islands, keys_of, unnest, with_halo, with_position

# Floor of the amplitude and dynamic range in dB.
AMIN = 1e-5
TOP_DB = 80.0

# Frames per chunk of the rolling windows: with its halo a chunk stays below the 4,096 rows that a window
# operator keeps in plain memory by default.
WINDOW_CHUNK = 3968


def rms_envelope(samples: DataFrame, *, by="match_id", frame: int, hop: int) -> DataFrame:
    """Root mean square of `x` over windows of `frame` samples every `hop`, centred and zero padded.

    Samples are first summed per block of gcd(frame, hop), on the map side; only blocks are then
    assigned to the windows that cover them.
    """
    keys = keys_of(by)
    block = math.gcd(frame, hop)
    half = frame // 2
    per_frame, per_hop = frame // block, hop // block
    blocks = (samples.withColumn("_blk", F.floor((F.col("idx") + half) / block).cast("long"))
              .groupBy(*keys, "_blk").agg(F.sum(F.col("x") * F.col("x")).alias("_e"), F.max("idx").alias("_top")))
    count = (blocks.groupBy(*keys).agg((F.max("_top") + 1).alias("_len"))
             .select(*keys, F.floor((F.col("_len") + 2 * half - frame) / hop).cast("long").alias("_last_hop")))
    first = F.greatest(F.lit(0), F.ceil((F.col("_blk") - per_frame + 1) / per_hop)).cast("long")
    final = F.floor(F.col("_blk") / per_hop).cast("long")
    hops = (blocks.filter(first <= final).withColumn("hop_no", F.explode(F.sequence(first, final)))
            .groupBy(*keys, "hop_no").agg(F.sum("_e").alias("_e")))
    return (hops.join(count, keys).filter(F.col("hop_no") <= F.col("_last_hop"))
            .select(*keys, "hop_no", F.sqrt(F.col("_e") / frame).alias("rms")))


def _placed(df: DataFrame, by) -> DataFrame:
    """Adds `_pos`, the place of a row of a key along `idx`: windows count rows, whatever the gaps in `idx`."""
    return df if "_pos" in df.columns else with_position(df, by, ["idx"], bucket=chunk_no("idx"), name="_pos")


def loudness_db(frames: DataFrame, *, by="match_id", col: str = "rms", chunk: int = CHUNK, placed: bool = False) -> DataFrame:
    """Amplitude in dB, floored at the loudest frame of the match minus 80 dB.

    `placed` adds `_pos` for the windows on the way, from the same chunks.
    """
    keys = keys_of(by)
    rows = (frames.withColumn("_raw", 20 * F.log10(F.greatest(F.lit(AMIN), F.col(col) + 1e-9)))
            .withColumn("_b", chunk_no("idx", chunk)))
    key = Window.partitionBy(*keys)
    ahead = key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "_b").agg(F.max("_raw").alias("_top"), F.count(F.lit(1)).alias("_n"))
    chunks = chunks.select(*keys, "_b", F.max("_top").over(key).alias("_top"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    place = []
    if placed:
        rows = rows.repartition(*keys, "_b").withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("idx")))
        place = [(F.col("_off") + F.col("_rn") - 1).cast("long").alias("_pos")]
    return (rows.join(chunks, [*keys, "_b"])
            .select(*frames.columns, F.greatest("_raw", F.col("_top") - TOP_DB).alias("db"), *place))


def _average(col: str, w: int, window) -> Column:
    # 'same' convolution with an even kernel reaches one row further back than ahead
    return F.sum(col).over(window.rowsBetween(-(w // 2), w - 1 - w // 2)) / w


def moving_avg(df: DataFrame, col: str, w: int, *, by="match_id", name: str = "smooth",
               chunk: int = WINDOW_CHUNK) -> DataFrame:
    """Box average of `w` rows along `idx`, which may have gaps; rows beyond the ends count as zero."""
    if w <= 1:
        return df.withColumn(name, F.col(col))
    rows = with_halo(_placed(df, by), by, "_pos", size=max(chunk, w), before=w // 2, after=w - 1 - w // 2)
    step = Window.partitionBy(*keys_of(by), "_chunk").orderBy("_pos")
    return rows.withColumn(name, _average(col, w, step)).filter("_own").select(*df.columns, name)


def _with_zscore(rows: DataFrame, col: str, w: int, window, name: str) -> DataFrame:
    near = window.rowsBetween(-(w // 2), w // 2)
    rows = rows.withColumn("_spread", F.stddev_pop(col).over(near)).withColumn("_near", F.sort_array(F.collect_list(col).over(near)))
    n = F.size("_near")
    low = F.element_at("_near", F.floor((n + 1) / 2).cast("int"))
    high = F.element_at("_near", F.floor(n / 2).cast("int") + 1)
    # a one-row window makes the median a plain column: a filter on z pushed below a projection would sort again
    rows = rows.withColumn("_median", F.max((low + high) / 2).over(window.rowsBetween(0, 0)))
    return rows.withColumn(name, (F.col(col) - F.col("_median")) / (F.col("_spread") + 1e-6))


def rolling_z(df: DataFrame, col: str, w: int, *, by="match_id", name: str = "z", chunk: int = WINDOW_CHUNK) -> DataFrame:
    """Distance from the rolling median in rolling standard deviations, over +-w/2 rows along `idx`."""
    rows = with_halo(_placed(df, by), by, "_pos", size=max(chunk, w), before=w // 2, after=w // 2)
    step = Window.partitionBy(*keys_of(by), "_chunk").orderBy("_pos")
    return _with_zscore(rows, col, w, step, name).filter("_own").select(*df.columns, name)


def smoothed_z(df: DataFrame, col: str, *, smooth: int, baseline: int, by="match_id", chunk: int = WINDOW_CHUNK,
               keep_chunk: bool = False) -> DataFrame:
    """`moving_avg` then `rolling_z` with one exchange: the halo covers the reach of both.

    `keep_chunk` keeps the row's place and chunk number, by which the rows stay partitioned, for `audio_peaks`;
    the chunk must not be smaller than the halo then.
    """
    reach = baseline // 2 + smooth
    if keep_chunk and chunk < reach:
        raise ValueError(f"chunk {chunk} is smaller than the reach {reach} of the windows")
    rows = with_halo(_placed(df, by), by, "_pos", size=max(chunk, reach), before=reach, after=reach)
    step = Window.partitionBy(*keys_of(by), "_chunk").orderBy("_pos")
    averaged = _average(col, smooth, step) if smooth > 1 else F.col(col)
    rows = rows.withColumn("smooth", averaged)
    rows = _with_zscore(rows, "smooth", baseline, step, "z").filter("_own")
    return rows.select(*df.columns, "smooth", "z", *(["_chunk"] if keep_chunk else []),
                       *(["_pos"] if keep_chunk and "_pos" not in df.columns else []))


def audio_peaks(df: DataFrame, *, thr: float = 2.2, by="match_id", chunk: int = WINDOW_CHUNK) -> DataFrame:
    """Highest frame (first on ties) of each run of consecutive frames with z > thr."""
    keys = keys_of(by)
    best = F.struct(F.col("z").alias("z"), (-F.col("idx")).alias("neg"), F.col("t").alias("t"))
    chunked = "_chunk" if "_chunk" in df.columns else None
    runs = islands(_placed(df, by).filter(F.col("z") > thr), by, "_pos", best, size=chunk, chunked=chunked)
    return runs.select(*keys, (-F.col("best.neg")).alias("idx"), F.col("best.t").alias("t"),
                       F.col("best.z").alias("z"), "n")


def _higher(state: Column, p: Column, gap: float) -> Column:
    """Kept peak after seeing `p`: a new one beyond the gap, the higher one within it."""
    fresh = state.isNull() | (p["t"] - state["t"] >= gap)
    return F.when(fresh | (p["z"] > state["z"]), p).otherwise(state)


def merge_peaks(peaks: DataFrame, *, min_gap: float = 25.0, by="match_id", chunk_seconds: float = 3600.0) -> DataFrame:
    """Keeps the higher of two peaks closer than `min_gap`; the kept one is the reference for the next.

    The kept peak depends on all peaks before it, so time is cut into chunks: each chunk works out the kept
    peak at its end for every peak that may be kept at its start (those within `min_gap` before it), one
    pass over the chunk summaries picks the true entry, and each chunk then runs once more from it.
    """
    keys = keys_of(by)
    span = max(chunk_seconds, min_gap)
    point = F.struct(F.col("t").cast("double").alias("t"), F.col("z").cast("double").alias("z"))
    kind = "struct<t:double,z:double>"
    chunks = (with_halo(peaks, by, "t", size=span, before=min_gap).withColumn("_p", point)
              .groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_own", "_p"))).alias("_all")))
    pick = lambda own: F.transform(F.filter("_all", lambda x: x["_own"] == own), lambda x: x["_p"])
    # both passes below read the same exchange
    chunks = chunks.select(*keys, "_chunk", pick(True).alias("own"), pick(False).alias("early")).filter(F.size("own") > 0)
    none = F.lit(None).cast(kind)

    def leave(entry):
        return F.aggregate("own", entry, lambda s, p: _higher(s, p, min_gap))

    summary = chunks.select(
        *keys, "_chunk", leave(none).alias("plain"),
        F.transform("early", lambda e: F.struct(e.alias("entry"), leave(e).alias("exit"))).alias("exits"))
    line = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "plain", "exits"))).alias("cs"))
    entries = unnest(line.withColumn("_final", F.element_at("cs", -1)["_chunk"]), [*keys, "_final"], F.aggregate(
        "cs", F.struct(none.alias("s"), F.array().cast(f"array<struct<c:bigint,s:{kind}>>").alias("out")),
        lambda acc, c: F.struct(
            F.coalesce(F.get(F.filter(c["exits"], lambda x: x["entry"] == acc["s"]), F.lit(0))["exit"], c["plain"]).alias("s"),
            F.array_append(acc["out"], F.struct(c["_chunk"].alias("c"), acc["s"].alias("s"))).alias("out")))["out"], "_e")
    entries = entries.select(*keys, F.col("_e.c").alias("_chunk"), F.col("_e.s").alias("_entry"), "_final")

    def step(acc, p):
        closes = acc["s"].isNotNull() & (p["t"] - acc["s"]["t"] >= min_gap)
        return F.struct(_higher(acc["s"], p, min_gap).alias("s"),
                        F.when(closes, F.array_append(acc["out"], acc["s"])).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.col("_entry").alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
    final = F.col("_chunk") == F.col("_final")
    kept = F.aggregate("own", start, step, lambda acc: F.when(final, F.array_append(acc["out"], acc["s"])).otherwise(acc["out"]))
    return unnest(chunks.join(entries, [*keys, "_chunk"]), keys, kept, "_k").select(*keys, "_k.t", "_k.z")


def peak_signals(peaks: DataFrame, *, thr: float = 2.2, by="match_id") -> DataFrame:
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - thr) / (thr + 1.0)))
    return peaks.select(*keys_of(by), "t", F.lit("audio").alias("source"), strength.alias("strength"),
                        F.col("z").alias("zscore"))
