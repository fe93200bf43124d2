"""Jersey colours and teams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import truncate
from ..functions.ordered import chunk_no, keys_of
from ..sources.state import cut_lineage

# Histogram of 16 hue bins over 0..180 and 8 saturation bins over 0..256.
HUE_BINS, HUE_TOP = 16, 180
SAT_BINS, SAT_TOP = 8, 256
# Torso band as shares of the box height.
BAND_TOP, BAND_BOTTOM = 0.2, 0.55


def torso_box(dets: DataFrame) -> DataFrame:
    """Pixel box of the shirt inside a player box; empty boxes are dropped."""
    x1, y1, x2, y2 = (truncate(F.col(c)) for c in ("x1", "y1", "x2", "y2"))
    h = y2 - y1
    zero = F.lit(0)
    rows = dets.withColumns({
        "tx1": F.greatest(zero, x1), "tx2": F.greatest(zero, x2),
        "ty1": F.greatest(zero, y1 + truncate(F.lit(BAND_TOP) * h)),
        "ty2": F.greatest(zero, y1 + truncate(F.lit(BAND_BOTTOM) * h))})
    return rows.filter((F.col("tx2") > F.col("tx1")) & (F.col("ty2") > F.col("ty1")))


def jersey_hist(pixels: DataFrame, *, by="owner") -> DataFrame:
    """L2-normalised hue x saturation histogram, one row per owner and bin (all 128 bins present)."""
    keys = keys_of(by)
    inside = (F.col("h") >= 0) & (F.col("h") < HUE_TOP) & (F.col("s") >= 0) & (F.col("s") < SAT_TOP)
    slot = (F.floor(F.col("h") * HUE_BINS / HUE_TOP) * SAT_BINS + F.floor(F.col("s") * SAT_BINS / SAT_TOP)).cast("int")
    counts = pixels.groupBy(*keys, F.when(inside, slot).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col("bin").isNotNull(), F.col("c"))
    # at most 129 rows per owner from here on
    rows = counts.groupBy(*keys).agg(
        F.sqrt(F.sum(hit * hit)).alias("_norm"),
        F.map_from_entries(F.collect_list(F.when(hit.isNotNull(), F.struct("bin", "c")))).alias("_m"))
    n = HUE_BINS * SAT_BINS
    return (rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .select(*keys, "bin", F.coalesce(F.try_element_at("_m", F.col("bin")) / F.col("_norm"), F.lit(0.0)).alias("value")))


def team_vote(labels: DataFrame, *, by="clip_id") -> DataFrame:
    """Most frequent cluster label per track, the label seen first on ties."""
    keys = keys_of(by)
    counts = labels.groupBy(*keys, "track_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("since"))
    return counts.groupBy(*keys, "track_id").agg(
        F.max_by("label", F.struct("n", (-F.col("since")).alias("s"))).alias("team"), F.sum("n").alias("n"))


def _gap2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _chance(start, centre, order):
    """Number in (0, 1) from a digest of the start, the centre and the place of a feature: the same in every run."""
    digest = F.md5(F.concat_ws(":", start.cast("string"), F.lit(str(centre)), *[F.col(c).cast("string") for c in order]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def _lloyd(x: np.ndarray, centres: np.ndarray, rounds: int):
    """Passes of k-means until no label moves: least squared distances and labels."""
    labels = None
    for _ in range(rounds):
        gaps = np.stack([((x - c) ** 2).sum(axis=1) for c in centres])
        new = gaps.argmin(axis=0)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.stack([x[labels == i].mean(axis=0) if (labels == i).any() else c for i, c in enumerate(centres)])
    return gaps.min(axis=0).sum(), labels


def _one_clip(pdf: pd.DataFrame, k: int, starts: int, rounds: int, order) -> np.ndarray:
    """Labels of the features of one clip, which are sorted along `order`."""
    x, u = np.stack(pdf["feature"]).astype(float), np.stack(pdf["_u"]).reshape(len(pdf), starts, k)
    ends = []
    for s in range(starts):
        centres = [x[u[:, s, 0].argmin()]]
        for j in range(1, k):
            gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            pull = np.divide(np.log(u[:, s, j]), gap, out=np.full(len(x), -np.inf), where=gap > 0)
            centres.append(x[pull.argmax()] if gap.any() else centres[0])
        ends.append(_lloyd(x, np.stack(centres), rounds))
    least = min(e for e, _ in ends)
    labels = next(lab for e, lab in ends if e <= least * (1 + 1e-9))
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return first.argsort().argsort()[inverse]


def team_kmeans(features: DataFrame, k: int = 2, *, by="clip_id", order=("frame", "track_id"), starts: int = 5, rounds: int = 300,
                whole: int = 1 << 14, chunk: int = 256) -> DataFrame:
    """k-means of jersey vectors (`feature` array<double>) per clip: the best of several starts, run until no label moves.

    Every start draws its centres with chances that grow with the squared distance to those drawn before, from digests
    instead of a random generator. The start with the least sum of squared distances wins, the first of equal ones. Clusters are
    numbered by their first feature along `order`, so labels do not depend on the start. Clips with fewer than
    3 * k features get no labels, rows without a feature are left out.

    Clips of up to `whole` features, which are counted first, are each solved in one task; all others go through passes
    over their rows (`_passes`), so no task holds more features than that.
    """
    keys = keys_of(by)
    features = features.filter(F.col("feature").isNotNull())
    sizes = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    chances = F.array(*[_chance(F.lit(s), j, order) for s in range(starts) for j in range(k)])

    def solve(pdf):
        if not 3 * k <= len(pdf):
            return pdf.iloc[:0].drop(columns="_u").assign(label=pd.Series(dtype="int32"))
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.drop(columns="_u").assign(label=_one_clip(pdf, k, starts, rounds, order).astype("int32"))

    schema = features.withColumn("label", F.lit(0)).schema
    if most <= whole:
        return features.withColumn("_u", chances).groupBy(*keys).applyInPandas(solve, schema)
    small = features.join(sizes.filter(F.col("_n") <= whole).select(*keys), keys, "left_semi")
    large = features.join(sizes.filter(F.col("_n") > whole).select(*keys), keys, "left_semi")
    return (small.withColumn("_u", chances).groupBy(*keys).applyInPandas(solve, schema)
            .unionByName(_passes(large, k, keys, order, starts, rounds, chunk)))


def _passes(features: DataFrame, k: int, keys: list[str], order, starts: int, rounds: int, chunk: int) -> DataFrame:
    """`team_kmeans` of large clips, all clips and starts side by side in each pass.

    A start is done when a pass leaves the same features in every cluster (their counts and hashes say so), and only the others go
    on. Only k centres per start and clip move between passes; features are kept once. Centres are copied to the chunks of
    their clip (along the first column of `order`), so a clip spreads over tasks, and each task sends one partial mean per centre.
    """
    rows = cut_lineage(features.withColumn("_b", chunk_no(order[0], chunk)))
    parts = cut_lineage(rows.select(*keys, "_b").distinct())
    place = F.struct(*order)

    def nearest(state):
        """Each feature beside the centres `_cs` of the starts of its clip that still move."""
        packed = state.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in state.columns if c not in keys])).alias("_p"))
        near = rows.join(parts.join(packed, keys), [*keys, "_b"])
        near = near.select(*keys, "feature", *order, F.explode("_p").alias("_p")).select(*keys, "feature", *order, "_p.*")
        near = near.withColumn("_gaps", F.transform("_cs", lambda c: _gap2(F.col("feature"), c)))
        return near.withColumn("_gap", F.array_min("_gaps"))

    def label():
        return (F.array_position("_gaps", F.col("_gap")) - 1).cast("int")

    drawn = rows.groupBy(*keys).agg(*[F.min_by("feature", F.struct(_chance(F.lit(s), 0, order), place)).alias(f"_{s}") for s in range(starts)])
    state = drawn.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("_s"), F.array(f"_{s}").alias("_cs")) for s in range(starts)])))
    for centre in range(1, k):
        near = nearest(cut_lineage(state))
        pull = F.when(F.col("_gap") > 0, F.log(_chance(F.col("_s"), centre, order)) / F.col("_gap"))
        state = near.groupBy(*keys, "_s").agg(F.first("_cs").alias("_cs"), F.max_by("feature", F.when(pull.isNotNull(), F.struct(pull, place))).alias("_f"))
        state = state.select(*keys, "_s", F.array_append("_cs", F.coalesce("_f", F.col("_cs")[0])).alias("_cs"))
    state, done = state.withColumn("_held", F.lit(None).cast("array<struct<label:int,n:bigint,h:bigint>>")), None
    cluster = F.struct("label", "_mean", "_n", "_h", "_first")
    for i in range(rounds):
        near = nearest(state).withColumn("label", label())
        sums = near.groupBy(*keys, "_s", "label").agg(
            Summarizer.mean(array_to_vector("feature")).alias("_mean"), F.sum("_gap").alias("_gap"), F.count(F.lit(1)).alias("_n"),
            F.bit_xor(F.xxhash64(*order)).alias("_h"), F.min(place).alias("_first"), F.first("_cs").alias("_cs"), F.first("_held").alias("_held"))
        sums = sums.withColumn("_mean", vector_to_array("_mean")).groupBy(*keys, "_s").agg(
            F.first("_cs").alias("_cs"), F.first("_held").alias("_was"), F.sum("_gap").alias("_gap"), F.sort_array(F.collect_list(cluster)).alias("_l"))
        held = F.transform("_l", lambda c: F.struct(c["label"].alias("label"), c["_n"].alias("n"), c["_h"].alias("h")))
        sums = cut_lineage(sums.withColumn("_held", held))
        still = F.col("_was").eqNullSafe(F.col("_held")) | F.lit(i == rounds - 1)
        done = sums.filter(still) if done is None else done.unionByName(sums.filter(still))
        new = F.map_from_entries(F.transform("_l", lambda c: F.struct(c["label"], c["_mean"])))
        state = sums.filter(~still).select(*keys, "_s", F.transform("_cs", lambda c, j: F.coalesce(F.try_element_at(new, j), c)).alias("_cs"), "_held")
        if state.isEmpty():
            break
    # the clusters of the best start, in order of their first feature
    best = done.groupBy(*keys).agg(F.min("_gap").alias("_least"), F.collect_list(F.struct("_s", "_gap", "_cs", "_l")).alias("_all"))
    best = best.withColumn("_all", F.array_sort(F.filter("_all", lambda x: x["_gap"] <= F.col("_least") * (1 + 1e-9)), lambda x, y: x["_s"] - y["_s"]))
    won = best.select(*keys, F.col("_all")[0].alias("_x"))
    by_first = F.array_sort(F.transform("_x._l", lambda c: F.struct(c["_first"].alias("first"), c["label"].alias("label"))))
    won = won.select(*keys, F.transform(by_first, lambda c: F.get(F.col("_x._cs"), c["label"])).alias("_cs"))
    final = rows.join(parts.join(won, keys), [*keys, "_b"])
    final = final.withColumn("_gaps", F.transform("_cs", lambda c: _gap2(F.col("feature"), c))).withColumn("_gap", F.array_min("_gaps"))
    return final.select(*features.columns, label().alias("label"))
