"""Choice and timeline of reel segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BrandConfig, ReelConfig
from ..functions.ordered import keys_of, unnest, unnest_numbered
from ..sources.state import cut_lineage


def _greedy(items, total, chosen, cfg):
    """Greedy choice along sorted items, from the length and the number of those chosen before."""
    state = F.struct(total.alias("total"), chosen.alias("n"), F.lit(False).alias("done"), F.slice(items, 1, 0).alias("out"))

    def take(acc, x):
        skip = acc["done"] | ((acc["total"] + x["d"] > cfg.max_seconds) & (acc["n"] > 0))
        total = acc["total"] + x["d"]
        return F.when(skip, acc).otherwise(F.struct(
            total.alias("total"), (acc["n"] + 1).alias("n"), (total >= cfg.target).alias("done"), F.array_append(acc["out"], x).alias("out")))

    return F.aggregate(items, state, take)


def _in_rounds(rows: DataFrame, keys, cfg: ReelConfig, chunk: int) -> DataFrame:
    """Chosen items (keys, _x) of large reels, chunk by chunk.

    The items of a reel are cut into chunks along the confidence. A reel carries its length, the number of items chosen and the chunk it
    is at. In each round it goes on to the next chunk with an item short enough to fit, if it is not done, and chooses there; such a
    chunk always adds an item, so there are never more rounds than chosen items. Only summaries of chunks meet per reel.
    """
    part = F.floor(F.col("_x.nc") * 64).cast("long")
    place = F.row_number().over(Window.partitionBy(*keys, "_cb").orderBy("_x"))
    cells = (rows.withColumn("_cb", part).withColumn("_cs", F.floor((place - 1) / chunk).cast("long"))
             .groupBy(*keys, F.struct("_cb", "_cs").alias("_at")).agg(F.sort_array(F.collect_list("_x")).alias("_i"), F.min("_x.d").alias("_least")))
    cells = cut_lineage(cells)
    light, chosen = cells.select(*keys, "_at", "_least"), None
    state = light.groupBy(*keys).agg(F.lit(0.0).alias("_total"), F.lit(0).alias("_n"), F.first("_at").alias("_was")).withColumn("_was", F.lit(None).cast(cells.schema["_at"].dataType))
    while True:
        fits = (F.col("_n") == 0) | (F.col("_total") + F.col("_least") <= cfg.max_seconds)
        ahead = F.col("_was").isNull() | (F.col("_at") > F.col("_was"))
        turn = state.join(light, keys).filter(fits & ahead).groupBy(*keys, "_total", "_n").agg(F.min("_at").alias("_at"))
        turn = turn.join(cells.drop("_least"), [*keys, "_at"]).select(*keys, "_at", _greedy(F.col("_i"), F.col("_total"), F.col("_n"), cfg).alias("_s"))
        turn = cut_lineage(turn)
        taken = turn.select(*keys, F.explode("_s.out").alias("_x"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        state = turn.filter(~F.col("_s.done")).select(*keys, F.col("_s.total").alias("_total"), F.col("_s.n").alias("_n"), F.col("_at").alias("_was"))
        if state.isEmpty():
            return chosen


def select_reel(items: DataFrame, cfg: ReelConfig | None = None, *, by="reel_id", chunk: int = 1024) -> DataFrame:
    """Greedy choice: by confidence, skipping what would exceed `max_seconds`, until `target` is reached.

    The first item is taken whatever its length. Chosen rows come with `slot`, their chronological place.
    Items are kept once and counted; where no reel has more than `chunk`, each is chosen from in one row, otherwise
    reels go through their items chunk by chunk (`_in_rounds`), so no row holds more than a chunk. Other columns
    travel along (they must be of sortable types); there is no join back to the items.
    """
    cfg = cfg or ReelConfig()
    keys = keys_of(by)
    rest = [c for c in items.columns if c not in (*keys, "ord", "duration")]
    d = F.least(F.col("duration"), F.lit(float(cfg.per_item))) if cfg.per_item else F.col("duration")
    item = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("nc"), F.col("ord").cast("long").alias("ord"),
                    d.cast("double").alias("d"), F.struct(*rest).alias("rest"))
    rows = cut_lineage(items.select(*keys, item.alias("_x")))
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= chunk:
        whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_i"))
        chosen = unnest(whole, keys, _greedy(F.col("_i"), F.lit(0.0), F.lit(0), cfg)["out"], "_x")
    else:
        chosen = _in_rounds(rows, keys, cfg, chunk)
    in_time = F.row_number().over(Window.partitionBy(*keys).orderBy("_x.ord", "_x.d", "_x.rest")) - 1
    return chosen.select(*keys, "_x.ord", F.col("_x.d").alias("duration"), *[F.col(f"_x.rest.{c}") for c in rest], in_time.cast("long").alias("slot"))


def segments():
    """Aggregate of the chosen rows of a reel, in order; a reel holds about a minute of them."""
    return F.sort_array(F.collect_list(F.struct("slot", "ord", F.col("duration").cast("double").alias("duration")))).alias("segments")


def timeline_parts(brand: BrandConfig, intro: bool = True, outro: bool = True):
    """Parts of a reel (column `segments`) with running times: intro card, segments, outro card."""
    kind = "array<struct<part:string,ord:bigint,duration:double,start_s:double,end_s:double>>"
    none, card = F.lit(None).cast("long"), F.lit(brand.card_seconds)

    def part(name, ord_, duration, at):
        return F.struct(F.lit(name).alias("part"), ord_.alias("ord"), duration.alias("duration"), at.alias("start_s"), (at + duration).alias("end_s"))

    first = F.array(part("intro", none, card, F.lit(0.0))) if intro else F.array()
    state = F.struct(F.lit(brand.card_seconds if intro else 0.0).alias("at"), first.cast(kind).alias("out"))
    add = lambda acc, s: F.struct((acc["at"] + s["duration"]).alias("at"),
                                  F.array_append(acc["out"], part("segment", s["ord"], s["duration"], acc["at"])).alias("out"))
    last = lambda acc: F.array_append(acc["out"], part("outro", none, card, acc["at"])) if outro else acc["out"]
    return F.aggregate("segments", state, add, last)


def explode_parts(reels: DataFrame, parts, *keep) -> DataFrame:
    return unnest_numbered(reels, keep, parts, "part_no", "_p").select(*keep, "part_no", "_p.*")


def reel_timeline(chosen: DataFrame, brand: BrandConfig | None = None, *, by="reel_id",
                  intro: bool = True, outro: bool = True) -> DataFrame:
    """Parts of a reel with start and end: intro card, segments in order, outro card."""
    keys = keys_of(by)
    reels = chosen.groupBy(*keys).agg(segments())
    return explode_parts(reels, timeline_parts(brand or BrandConfig(), intro, outro), *keys)


def clip_timeline(clips: DataFrame, brand: BrandConfig | None = None, *, by="clip_id", body: str = "duration",
                  with_cards: bool = True) -> DataFrame:
    """Start and end of intro, freeze frame, body and outro of one finished clip."""
    brand = brand or BrandConfig()
    parts = [("freeze", F.lit(brand.freeze_seconds)), ("body", F.col(body))]
    if with_cards:
        parts = [("intro", F.lit(brand.card_seconds)), *parts, ("outro", F.lit(brand.card_seconds))]
    rows, at = [], F.lit(0.0)
    for i, (name, length) in enumerate(parts):
        rows.append(F.struct(F.lit(i).cast("long").alias("part_no"), F.lit(name).alias("part"),
                             at.alias("start_s"), (at + length).alias("end_s")))
        at = at + length
    return clips.select(*keys_of(by), F.inline(F.array(*rows)))
