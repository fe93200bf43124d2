"""Signals of all detectors -> clusters -> scored, classified, ranked and padded moments.

All cluster work runs on cells: signals closer than half the gap always belong together, so each
(match, half-gap cell, source) is pre-aggregated on the map side. What is ordered per match afterwards is
bounded by the match length (`length / (gap/2) * sources`), however many signals the match has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DETECTOR_ORDER, FusionConfig, MomentConfig, PadConfig
from ..functions.numbers import round_exact
from ..functions.ordered import keys_of
from ..schemas import SIGNAL_META

# One bit per label a cluster can get from its signals, so that a single bit_or keeps them all
SPOT_BITS = {"goal": 1, "card": 2, "save": 4, "chance": 8}
TALK_BITS = {"goal": 16, "card": 32, "chance": 64}
SAVED_BIT = 128


def detector_rank() -> Column:
    """Order of detectors in a match's signal list, which decides between signals at the same time."""
    rank = F.lit(len(DETECTOR_ORDER))
    for i, source in reversed(list(enumerate(DETECTOR_ORDER))):
        rank = F.when(F.col("source") == source, i).otherwise(rank)
    return rank


def label_bits() -> Column:
    def of(bits):
        value = F.lit(0)
        for kind, bit in bits.items():
            value = F.when(F.col("kind_hint") == kind, bit).otherwise(value)
        return value

    hint = (F.when(F.col("source") == "action_spotting", of(SPOT_BITS))
            .when(F.col("source") == "commentary", of(TALK_BITS)).otherwise(0))
    return hint.bitwiseOR(F.when(F.contains("phrase", F.lit("saved")), SAVED_BIT).otherwise(0))


def all_signals(*detectors: DataFrame, by="match_id") -> DataFrame:
    """Bag union of detector outputs; `det` is the rank of the detector, the first tie-break in time.

    Missing columns are filled with null, `seq` is the order inside a detector.
    """
    out = None
    for d in detectors:
        if "seq" not in d.columns:
            d = d.withColumn("seq", F.lit(0).cast("long"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    for name, kind in SIGNAL_META.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select(*keys_of(by), "t", detector_rank().alias("det"), F.col("seq").cast("long").alias("seq"),
                      "source", "strength", *[F.col(n).cast(k).alias(n) for n, k in SIGNAL_META.items()])


def _cell(gap: float) -> Column:
    if gap <= 0:
        raise ValueError("gap must be positive")
    # half the gap: no rounding of t / width can put two signals further apart than the gap in one cell
    return F.floor(F.col("t") / (gap / 2)).cast("long")


def _number_cells(cells: DataFrame, keys, gap: float) -> DataFrame:
    """Adds `_start`, the first cell of the cluster a cell belongs to. Cells have `_cell`, `_lo`, `_hi`."""
    line = Window.partitionBy(*keys).orderBy("_cell")
    # values of all earlier cells: the greatest time so far is the time of the last signal before this cell
    reached = F.max("_hi").over(line.rangeBetween(Window.unboundedPreceding, -1))
    cell_lo = F.min("_lo").over(line.rangeBetween(0, 0))
    opens = F.coalesce(cell_lo - F.col("_reached") > gap, F.lit(True))
    return (cells.withColumn("_reached", reached).withColumn("_cell_lo", cell_lo)
            .withColumn("_open", F.when(opens, F.col("_cell")))
            .withColumn("_start", F.max("_open").over(line.rangeBetween(Window.unboundedPreceding, 0)))
            .drop("_reached", "_cell_lo", "_open"))


def cluster_signals(signals: DataFrame, *, by="match_id", gap: float = 8.0) -> DataFrame:
    """Adds `cluster`, 0-based per match: a new one starts when a signal comes more than `gap` after the one before."""
    keys = keys_of(by)
    rows = signals.withColumn("_cell", _cell(gap))
    cells = rows.groupBy(*keys, "_cell").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    numbered = _number_cells(cells, keys, gap)
    no = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_start")) - 1
    numbered = numbered.select(*keys, "_cell", no.cast("long").alias("cluster"))
    return rows.join(numbered, [*keys, "_cell"]).select(*signals.columns, "cluster")


def clusters(signals: DataFrame, *, by="match_id", gap: float = 8.0) -> DataFrame:
    """One row per (match, cluster start, source) with everything that scoring and labelling need.

    Most of it are numbers that a hash aggregate keeps in place on the map side; only the loudest audio
    signal and the first minute need an ordering struct.
    """
    keys = keys_of(by)
    cells = signals.withColumn("_cell", _cell(gap)).groupBy(*keys, "_cell", "source").agg(
        F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.count(F.lit(1)).alias("n"),
        F.max("strength").alias("strength"), F.bit_or(label_bits()).alias("labels"),
        F.max(F.when(F.col("source") == "audio", F.struct("strength", (-F.col("t")).alias("nt")))).alias("audio"),
        F.min(F.when(F.col("minute").isNotNull(), F.struct("t", "seq", "minute"))).alias("minute"))
    return _number_cells(cells, keys, gap).groupBy(*keys, "_start", "source").agg(
        F.min("_lo").alias("first_t"), F.sum("n").alias("n"), F.max("strength").alias("strength"),
        F.bit_or("labels").alias("labels"), F.max("audio").alias("audio"), F.min("minute").alias("minute"))


def fuse_confidence(per_source: DataFrame, weights: dict | None = None, *, by="match_id") -> DataFrame:
    """One row per cluster: sum over sources of weight * strongest signal, at most 1 (unknown sources weigh 0).

    Sources are summed in order of appearance, so the double is the same on every run.
    """
    keys = keys_of(by)
    weights = FusionConfig().weights if weights is None else weights
    weight = F.lit(0.0)
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, float(w)).otherwise(weight)
    rank, share = detector_rank(), weight * F.col("strength")
    parts = F.sort_array(F.collect_list(F.struct("first_t", rank.alias("rank"), "source", share.alias("share"))))
    minute = F.when(F.col("minute").isNotNull(), F.struct(F.col("minute.t"), rank, F.col("minute.seq"), F.col("minute.minute").alias("minute")))
    return (per_source.groupBy(*keys, "_start").agg(
        parts.alias("_parts"), F.sum("n").alias("signal_count"), F.min("first_t").alias("first_t"),
        F.bit_or("labels").alias("labels"), F.min(minute).alias("_minute"), F.max("audio").alias("audio"),
        F.min(F.when(F.col("source") == "scoreboard_ocr", F.col("first_t"))).alias("board_t"))
        .withColumn("confidence", F.least(F.lit(1.0), F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["share"])))
        .withColumn("sources", F.sort_array(F.transform("_parts", lambda p: p["source"])))
        .withColumn("minute", F.col("_minute.minute")).drop("_parts", "_minute"))


def classify_clusters(fused: DataFrame) -> DataFrame:
    """Adds `kind`: spotting labels first, then a score change, then commentary, else a chance."""
    has = lambda bit: F.col("labels").bitwiseAND(F.lit(bit)) != 0
    kind = (F.when(has(SPOT_BITS["goal"]), "goal").when(has(SPOT_BITS["card"]), "card")
            .when(has(SPOT_BITS["save"]), "save").when(has(SPOT_BITS["chance"]), "chance")
            .when(F.col("board_t").isNotNull(), "goal")
            .when(has(TALK_BITS["goal"]), "goal").when(has(TALK_BITS["card"]), "card")
            .when(has(TALK_BITS["chance"]) & has(SAVED_BIT), "save").otherwise("chance"))
    return fused.withColumn("kind", kind)


def anchor_moments(fused: DataFrame, *, backoff: float = 6.0) -> DataFrame:
    """Adds `t`: shortly before the first score change, else the loudest moment, else the first signal."""
    # greatest() skips nulls, so the guard is needed
    board = F.when(F.col("board_t").isNotNull(), F.greatest(F.lit(0.0), F.col("board_t") - backoff))
    return fused.withColumn("t", F.coalesce(board, -F.col("audio.nt"), F.col("first_t")))


def top_moments(df: DataFrame, k: int = 25, *, by="match_id", tie=("first_t",)) -> DataFrame:
    """The k most confident moments per match, earlier ones first on ties.

    The row_number filter is pushed ahead of the exchange by Spark, so a match sends k rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys_of(by)).orderBy(F.desc("confidence"), *tie))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def limit_moments(df: DataFrame, n: int, *, by="match_id") -> DataFrame:
    """User limit on moments per match; 0 keeps all."""
    return top_moments(df, n, by=by, tie=("t",)) if n else df


def pad_moments(moments: DataFrame, durations: DataFrame, pads: PadConfig | None = None, *, by="match_id") -> DataFrame:
    """Adds `start_s`, `end_s`: the moment with lead-in and aftermath, inside the match.

    A match of unknown duration keeps its moments, with ends that are not cut.
    """
    pads = pads or PadConfig()
    goal = F.col("kind") == "goal"
    return (moments.join(durations.select(*keys_of(by), "duration"), keys_of(by), "left")
            .withColumn("start_s", F.greatest(F.lit(0.0), F.col("t") - F.when(goal, pads.goal_pre).otherwise(pads.pre)))
            .withColumn("end_s", F.least(F.col("duration"), F.col("t") + F.when(goal, pads.goal_post).otherwise(pads.post)))
            .drop("duration"))


def detect_moments(signals: DataFrame, durations: DataFrame, cfg: MomentConfig | None = None, *,
                   by="match_id") -> DataFrame:
    """Signals to padded moments; one exchange of pre-aggregated cells per match plus the duration join."""
    cfg = cfg or MomentConfig()
    f = cfg.fusion
    fused = fuse_confidence(clusters(signals, by=by, gap=f.gap), f.weights, by=by)
    kept = fused.filter(F.col("confidence") >= f.min_confidence)
    kept = kept.withColumn("confidence", round_exact(F.col("confidence"), 3))
    ranked = top_moments(anchor_moments(classify_clusters(kept), backoff=f.anchor_backoff), f.max_moments, by=by)
    return pad_moments(ranked, durations, cfg.pads, by=by).select(
        *keys_of(by), "t", "start_s", "end_s", "confidence", "kind", "minute", "sources", "signal_count")
