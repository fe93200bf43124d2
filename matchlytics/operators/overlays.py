"""Overlay texts, social captions, run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BrandConfig
from ..sources.state import cut_lineage
from ..functions.ordered import keys_of, unnest_numbered

#: Levels of nested documents that are opened in one go.
LEVELS = 4


def _shown(value: Column) -> Column:
    # half to even, as the overlay texts have always been rounded
    return F.bround(value).cast("long").cast("string")


def overlay_schedule(clips: DataFrame, brand: BrandConfig | None = None, *, by="clip_id") -> DataFrame:
    """Texts drawn on a clip, in drawing order, with times and style.

    `clips` has kind, minute, hook and the stats columns metric, sprint_distance_m, top_speed_kmh,
    shot_distance_m, players_beaten (null `metric` = no stats). Open-ended texts have null times.
    """
    brand = brand or BrandConfig()
    kind = "struct<text:string,t0:double,t1:double,style:string,y_offset:int>"

    def row(show, text, style, t0=None, t1=None):
        made = F.struct(text.alias("text"), F.lit(t0).cast("double").alias("t0"), F.lit(t1).cast("double").alias("t1"),
                        F.lit(style).alias("style"), F.lit(0).alias("y_offset"))
        return F.when(F.coalesce(show, F.lit(False)) & (text != ""), made)

    c = F.col
    approx = F.when(c("metric"), "").otherwise("~")
    label = F.upper("kind")
    if brand.show_minute:
        label = F.when(c("minute").isNotNull(), F.concat(label, F.lit("  -  "), c("minute").cast("string"), F.lit("'"))).otherwise(label)
    has = lambda name: c(name).isNotNull() & (c(name) != 0)
    told = c("metric").isNotNull()
    lines = []
    if brand.show_stats:
        if brand.show_shot_distance:
            lines.append(row(told & has("shot_distance_m"), F.concat(F.lit("Shot: "), approx, _shown(c("shot_distance_m")), F.lit(" m")), "stat"))
        if brand.show_sprint_distance:
            lines.append(row(told & has("sprint_distance_m"), F.concat(F.lit("Sprint: "), approx, _shown(c("sprint_distance_m")), F.lit(" m")), "stat"))
        if brand.show_top_speed:
            lines.append(row(told & has("top_speed_kmh"), F.concat(F.lit("Top speed: "), _shown(c("top_speed_kmh")), F.lit(" km/h")), "stat"))
        if brand.show_players_beaten:
            lines.append(row(told & c("players_beaten").isNotNull(), F.concat(F.lit("Beaten: "), c("players_beaten").cast("string")), "stat"))
    stacked = F.transform(F.array_compact(F.array(*lines)) if lines else F.array().cast(f"array<{kind}>"),
                          lambda s, i: s.withField("y_offset", i * brand.stat_step_px))
    head = []
    if brand.show_hook:
        head.append(row(F.lit(True), c("hook"), "hook", 0.0, brand.hook_seconds))
    if brand.show_lower_third:
        head.append(row(F.lit(True), label, "lower_third"))
    tail = [row(F.lit(True), F.lit(brand.watermark), "watermark")] if brand.show_watermark else []
    group = lambda rows: F.array_compact(F.array(*rows)).cast(f"array<{kind}>") if rows else F.array().cast(f"array<{kind}>")
    texts = F.concat(group(head), stacked.cast(f"array<{kind}>"), group(tail))
    return unnest_numbered(clips, keys_of(by), texts, "overlay_no", "_o").select(*keys_of(by), "overlay_no", "_o.*")


def _fill(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def clip_caption(clips: DataFrame, brand: BrandConfig | None = None) -> DataFrame:
    """Adds `caption`; the hook is the first one of the kind, empty for kinds without hooks."""
    brand = brand or BrandConfig()
    hook = F.lit("")
    for kind, texts in brand.hooks.items():
        if texts:
            hook = F.when(F.col("kind") == kind, F.lit(texts[0])).otherwise(hook)
    return clips.withColumn("caption", _fill(brand.caption_template, hashtags=F.lit(" ".join(brand.hashtags)),
                                             moment_type=F.upper("kind"), hook=hook))


def reel_counts():
    """Aggregates of the chosen rows of a reel that its caption needs."""
    return (F.count(F.lit(1)).alias("n_moments"), F.count_if(F.col("kind") == "goal").alias("n_goals"))


def reel_caption_text(brand: BrandConfig) -> Column:
    head = F.when(F.col("n_goals") > 0, F.concat(F.col("n_goals").cast("string"), F.lit(" goals"))).otherwise(
        F.concat(F.col("n_moments").cast("string"), F.lit(" moments")))
    pool = brand.hooks.get("goal") or [""]
    return _fill(brand.caption_template, hashtags=F.lit(" ".join(brand.hashtags)),
                 moment_type=F.upper(F.concat(head, F.lit(" in 60s"))), hook=F.lit(pool[0]))


def reel_caption(chosen: DataFrame, brand: BrandConfig | None = None, *, by="reel_id") -> DataFrame:
    """One caption per reel: its number of goals, or of moments if it has none."""
    return chosen.groupBy(*keys_of(by)).agg(*reel_counts()).withColumn("caption", reel_caption_text(brand or BrandConfig()))


def run_summary(clip_results: DataFrame, runs: DataFrame | None = None, *, mode: str = "per_clip", by="match_id") -> DataFrame:
    """Counts and status per run: ok if any clip is, failed if none is, empty for runs without clips."""
    keys = keys_of(by)
    counts = clip_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("moments"), F.count_if(F.col("kind") == "goal").alias("goals"),
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    if runs is not None:
        counts = runs.select(*keys).join(counts, keys, "left").na.fill(0, ["moments", "goals", "n_ok", "n_failed"])
    status = F.when(F.col("moments") == 0, "empty").when(F.col("n_ok") > 0, "ok").otherwise("failed")
    return counts.withColumn("status", status).withColumn("mode", F.lit(mode))


def _near(keys):
    """Leaves of a document in the order of their paths: what lies below a path follows it in one run."""
    return Window.partitionBy(*keys).orderBy("path", "_over")


def _whole(keys) -> Column:
    """Null keys and paths are like no others."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "path")])


def _starts_with(path, above) -> Column:
    return F.coalesce(F.slice(path, F.lit(1), F.size(above)) == F.col(above), F.lit(False))


def _overlay_leaves(leaves: DataFrame, keys) -> DataFrame:
    """Leaves (keys, path array, value) of base with those marked `_over` on top: an override leaf replaces everything below its path, an
    override below a base leaf replaces that leaf.

    The leaves of a document are brought together and sorted once, and each is told by its neighbours: the next override is
    below a leaf if any is, and a leaf is below an override if the farthest run that overrides before it began goes on.
    """
    near, same, over = _near(keys), Window.partitionBy(*keys, "path"), F.col("_over")
    end = F.array_append("path", F.lit(b"\xff").cast("string"))  # behind all paths below, as no text holds this byte
    rows = leaves.withColumns({"_at": F.when(over & _whole(keys), F.col("path")), "_end": F.when(over & _whole(keys), end)})
    rows = rows.withColumns({"_next": F.expr("lead(_at) ignore nulls").over(near),
                             "_reach": F.max("_end").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.withColumns({"_below": F.coalesce(F.col("_reach") > F.col("path"), F.lit(False)), "_above": _starts_with("_next", "path")})
    # as in a join, an override comes once for each base leaf that it replaces at the very path
    rows = rows.withColumns({"_deeper": F.max(over & _whole(keys) & F.col("_above") & (F.size("_next") > F.size("path"))).over(same),
                             "_n": F.count_if(~over & ~F.col("_below") & _whole(keys)).over(same)})
    times = F.when(over & _whole(keys) & ~F.col("_deeper"), F.greatest("_n", F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long"))
    rows = rows.filter(over | ~(F.col("_below") | F.col("_above")))
    return rows.select(*keys, "path", "value", over.alias("overridden"), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_i")).drop("_i")


def config_overlay(base: DataFrame, over: DataFrame, *, by="match_id") -> DataFrame:
    """Deep merge of nested settings given as (key, dotted path, value) leaves; `over` wins."""
    keys = keys_of(by)
    cut = lambda df, on_top: df.select(*keys, F.split("path", r"\.").alias("path"), "value", F.lit(on_top).alias("_over"))
    return _overlay_leaves(cut(base, False).unionByName(cut(over, True)), keys).withColumn("path", F.array_join("path", "."))


def _opened(rows: DataFrame) -> tuple[DataFrame, int]:
    """Leaves of `rows` (other columns, path, value), and the length of the longest path. Null values stay as they are.

    Objects are opened `LEVELS` levels at a time. What that gives is kept before it is looked at, so no document is read twice.
    """
    keys = [c for c in rows.columns if c not in ("path", "value")]
    kind, leaves, depth = F.schema_of_variant("value"), None, 0
    is_open = F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))
    explode = rows.sparkSession.tvf.variant_explode_outer
    while True:
        for _ in range(LEVELS):
            inner = rows.select(*keys, "path", F.col("value").alias("_value"), F.when(is_open, F.col("value")).alias("_object")).lateralJoin(explode(F.col("_object").outer()))
            opened = F.col("_object").isNotNull()
            rows = inner.select(*keys, F.when(opened, F.array_append("path", F.col("key"))).otherwise(F.col("path")).alias("path"),
                                F.when(opened, F.col("value")).otherwise(F.col("_value")).alias("value"))
        rows = cut_lineage(rows.withColumn("_open", is_open))
        closed = rows.filter(~F.col("_open")).drop("_open")
        leaves = closed if leaves is None else leaves.unionByName(closed)
        left, longest = rows.agg(F.count_if("_open"), F.max(F.size("path"))).first()
        depth = max(depth, longest or 0)
        if not left:
            return leaves, depth
        rows = rows.filter("_open").drop("_open")


def _roots(docs: DataFrame, doc: str) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != doc], F.array().cast("array<string>").alias("path"), F.col(doc).alias("value"))


def document_leaves(docs: DataFrame, doc: str = "settings") -> tuple[DataFrame, int]:
    """Leaves (other columns, path array, value) of VARIANT documents, and the length of the longest path.

    Lists, empty objects and JSON nulls are leaves.
    """
    return _opened(_roots(docs.filter(F.col(doc).isNotNull()), doc))


def _documents(leaves: DataFrame, depth: int, keys, doc: str) -> DataFrame:
    """VARIANT documents of their leaves, from the longest paths up. Each level is grouped where the rows of its key are already."""
    for n in range(depth, 0, -1):
        deep = F.size("path") == n
        parent = F.when(deep, F.slice("path", 1, n - 1)).otherwise(F.col("path"))
        entry = F.struct(F.when(deep, F.try_element_at("path", F.lit(n))).alias("k"), F.col("value").alias("v"))
        level = leaves.groupBy(*keys, deep.alias("_made"), parent.alias("path")).agg(F.collect_list(entry).alias("_e"))
        values = F.when(F.col("_made"), F.array(F.to_variant_object(F.map_from_entries("_e")))).otherwise(F.col("_e.v"))
        leaves = level.select(*keys, "path", F.explode(values).alias("value"))
    return leaves.select(*keys, F.col("value").alias(doc))


def merge_documents(base: DataFrame, over: DataFrame, *, by="match_id", doc: str = "settings") -> DataFrame:
    """Deep merge of nested settings, one VARIANT document per key; `over` wins.

    Objects are merged key by key, however deep; everything else in `over` (numbers, texts, nulls, whole lists) replaces what
    is there. Keys of either table come out, those without any document with null.
    """
    keys = keys_of(by)
    side = lambda df, on_top: df.select(*keys, F.col(doc), F.lit(on_top).alias("_over"))
    rows, depth = _opened(_roots(side(base, False).unionByName(side(over, True)), doc))
    # an empty object adds nothing to one that has something
    leaves = rows.filter("value is not null").withColumn("_at", F.when(~F.col("_over") & _whole(keys), F.col("path")))
    leaves = leaves.withColumn("_next", F.expr("lead(_at) ignore nulls").over(_near(keys)))
    empty = F.col("_over") & (F.schema_of_variant("value") == "OBJECT<>")
    leaves = leaves.filter(~(empty & _whole(keys) & _starts_with("_next", "path"))).drop("_at", "_next")
    merged = _documents(_overlay_leaves(leaves, keys).drop("overridden"), depth, keys, doc)
    return rows.select(*keys).distinct().join(merged, keys, "left")
