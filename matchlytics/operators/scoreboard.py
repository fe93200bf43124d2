"""Scoreboard text: sampling, region, score changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import truncate
from ..functions.ordered import chunk_no, keys_of, unnest
from ..functions.text import away_goals, home_goals, minute_text, minute_value, score_text
from ..sources.state import cut_lineage

# Fixed value: default region, top 18 % by left 55 % of the frame.
DEFAULT_ROI = (0.0, 0.0, 0.55, 0.18)
HOME = 1000  # a score is coded home * HOME + away


def sample_frames(df: DataFrame, *, every_s: float = 5.0, idx: str = "idx", fps: str = "fps") -> DataFrame:
    """Every frame whose index is a multiple of int(max(1, every_s * fps)), with its time `t`."""
    rate = F.when(F.coalesce(F.col(fps), F.lit(0.0)) == 0, F.lit(25.0)).otherwise(F.col(fps))
    step = truncate(F.greatest(F.lit(1.0), F.lit(float(every_s)) * rate))
    return df.filter(F.col(idx) % step == 0).withColumn("t", F.col(idx) / rate)


def stride(df: DataFrame, n: int, *, idx: str = "frame") -> DataFrame:
    return df.filter(F.col(idx) % n == 0) if n > 1 else df


def roi_box(df: DataFrame, roi=None) -> DataFrame:
    """Fractional region (x1, y1, x2, y2) of the frame as whole-pixel box columns."""
    x1, y1, x2, y2 = roi or DEFAULT_ROI
    px = lambda share, side: truncate(F.lit(float(share)) * F.col(side))
    return df.withColumns({"roi_x1": px(x1, "width"), "roi_y1": px(y1, "height"),
                           "roi_x2": px(x2, "width"), "roi_y2": px(y2, "height")})


def read_scores(ocr: DataFrame, *, text: str = "text", after_score: bool = False) -> DataFrame:
    """Adds home, away and minute parsed from the text; rows without a score keep nulls."""
    # each pattern runs once per text, in a step of its own
    rows = ocr.withColumns({"_score": score_text(F.col(text)), "_minute": minute_text(F.col(text), after_score)})
    return rows.withColumns({"home": home_goals(F.col("_score")), "away": away_goals(F.col("_score")),
                             "minute": minute_value(F.col("_minute"))}).drop("_score", "_minute")


def _moves(base: Column, code: Column) -> Column:
    """One more goal on exactly one side."""
    return (code - base == 1) | (code - base == HOME)


#: Baseline before the first score of a match; no code of a score, nor one goal less than one, is as small.
NONE = -(1 << 40)
#: Groups of readings whose maps are chained in one row.
FAN = 64


def _number_groups(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Running number `_g` of the groups (keys, _b, _s) of a match, over one row per chunk of time."""
    chunks = groups.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    return groups.join(offsets, [*keys, "_b"]).withColumn("_g", F.col("_off") + F.col("_s")).drop("_off")


def _compose(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Maps (keys, node, entry, exit) of neighbouring nodes 2n and 2n + 1 as one map of node n.

    A map holds the baselines that its node changes, and what becomes of NONE; all others stay as they are. So an exit
    of the left node goes on where the right node changes it, and an entry of the right node counts where the left
    node leaves it alone.
    """
    up = maps.withColumn("_up", F.shiftright("node", 1))
    left, right = (up.filter(F.col("node") % 2 == side).drop("node") for side in (0, 1))
    moved = left.join(right.select(*keys, "_up", F.col("entry").alias("exit"), F.col("exit").alias("_to")), [*keys, "_up", "exit"], "left")
    moved = moved.select(*keys, "_up", "entry", F.coalesce("_to", "exit").alias("exit"))
    own = right.filter(F.col("entry") != NONE).join(left.select(*keys, "_up", "entry"), [*keys, "_up", "entry"], "left_anti").select(*keys, "_up", "entry", "exit")
    return moved.unionByName(own).filter(F.col("entry") != F.col("exit")).withColumnRenamed("_up", "node")


def _block_entries(maps: DataFrame, keys: list[str], nodes: int, fan: int) -> DataFrame:
    """Baseline at the start of each block of `fan` groups, from the maps of single groups.

    The maps are composed pairwise, level by level, up to one node per match; then the baselines go down again: the left
    node of a pair has that of its parent, the right one what the left node's map makes of it. Both ways are
    joins on (match, node, baseline), so a match with very many groups is spread by all three. Every level is a table of its own.
    """
    levels, low = [maps], fan.bit_length() - 1
    while nodes > 1:
        levels.append(cut_lineage(_compose(levels[-1], keys)))
        nodes = (nodes + 1) // 2
    start = levels[-1].filter(F.col("entry") == NONE).select(*keys, "node", F.lit(NONE).cast("long").alias("entry"))
    for level in reversed(levels[low:-1]):
        parents = start.select(*keys, F.shiftleft("node", 1).alias("node"), "entry")
        after = parents.join(level, [*keys, "node", "entry"], "left").select(*keys, (F.col("node") + 1).alias("node"), F.coalesce("exit", "entry").alias("entry"))
        there = level.filter(F.col("entry") == NONE).select(*keys, "node")
        start = cut_lineage(parents.unionByName(after).join(there, [*keys, "node"], "left_semi"))
    return start.select(*keys, F.col("node").alias("_block"), F.when(F.col("entry") != NONE, F.col("entry")).alias("_start"))


def score_changes(df: DataFrame, *, by="match_id", chunk_seconds: float = 600.0, chunk: int = 512, fan: int = FAN) -> DataFrame:
    """Signals where the score grows by one on one side relative to the last accepted score.

    The first parsed score is the baseline; any other jump is ignored and leaves the baseline, so the
    outcome depends on everything before. Time is cut into chunks and these into groups of `chunk` readings, so that
    noisy texts make more groups, not larger ones. Each group maps every baseline it can change to the baseline
    at its end. The maps of up to `fan` groups are chained in one row; where a match may have more (one count of its rows
    tells), the maps are composed pairwise as rows first (`_block_entries`), so no row and no task holds a match. Each
    group then runs once from its true baseline. Repeats of the score before change nothing and are dropped first.
    """
    if fan < 1 or fan & (fan - 1):
        raise ValueError("fan must be a power of two")
    keys = keys_of(by)
    rows = (df.filter(F.col("home").isNotNull())
            .withColumn("_b", chunk_no("t", chunk_seconds))
            .withColumn("_code", (F.col("home") * HOME + F.col("away")).cast("long")))
    step = Window.partitionBy(*keys, "_b").orderBy("t", "seq")
    before = F.lag("_code").over(step)
    reads = (rows.withColumn("_same", F.coalesce(before == F.col("_code"), F.lit(False))).filter(~F.col("_same"))
             .withColumn("_s", F.floor((F.row_number().over(step) - 1) / chunk).cast("long"))
             .groupBy(*keys, "_b", "_s")
             .agg(F.sort_array(F.collect_list(F.struct("t", "seq", F.col("_code").alias("code"), "minute"))).alias("rs")))

    def leave(entry):
        return F.aggregate("rs", entry, lambda b, r: F.when(b.isNull() | _moves(b, r["code"]), r["code"]).otherwise(b))

    starts = F.array_distinct(F.flatten(F.transform("rs", lambda r: F.array(r["code"] - 1, r["code"] - HOME))))
    none = F.lit(None).cast("long")
    maps = lambda groups, *rest: groups.select(
        *keys, "_b", "_s", *rest, leave(none).alias("plain"),
        F.transform(starts, lambda e: F.struct(e.alias("entry"), leave(e).alias("exit"))).alias("exits"))
    most = (df.groupBy(*keys, chunk_no("t", chunk_seconds).alias("_b")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_n"))
            .groupBy(*keys).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0]) or 0
    if most <= fan:
        summary = maps(reads).withColumns({"_block": F.lit(0), "_start": none})
    else:
        reads = cut_lineage(reads)
        # one number per group, found without the readings
        numbers = cut_lineage(_number_groups(reads.select(*keys, "_b", "_s"), keys))
        summary = cut_lineage(maps(reads).join(numbers, [*keys, "_b", "_s"]))
        moves = F.filter("exits", lambda x: x["entry"] != x["exit"])
        singles = summary.select(*keys, F.col("_g").alias("node"), F.inline(F.concat(F.array(F.struct(F.lit(NONE).cast("long").alias("entry"), F.col("plain").alias("exit"))), moves)))
        nodes = summary.agg(F.max("_g")).first()[0] + 1
        blocks = _block_entries(singles, keys, nodes, fan)
        summary = summary.withColumn("_block", F.floor(F.col("_g") / fan).cast("long")).join(blocks, [*keys, "_block"])
    line = summary.groupBy(*keys, "_block").agg(F.max("_start").alias("_start"), F.sort_array(F.collect_list(F.struct("_b", "_s", "plain", "exits"))).alias("cs"))
    entries = unnest(line, keys, F.aggregate(
        "cs", F.struct(F.col("_start").alias("s"), F.array().cast("array<struct<b:bigint,g:bigint,s:bigint>>").alias("out")),
        lambda acc, c: F.struct(
            F.when(acc["s"].isNull(), c["plain"]).otherwise(F.coalesce(
                F.get(F.filter(c["exits"], lambda x: x["entry"] == acc["s"]), F.lit(0))["exit"], acc["s"])).alias("s"),
            F.array_append(acc["out"], F.struct(c["_b"].alias("b"), c["_s"].alias("g"), acc["s"].alias("s"))).alias("out")))["out"], "_e")
    entries = entries.select(*keys, F.col("_e.b").alias("_b"), F.col("_e.g").alias("_s"), F.col("_e.s").alias("_entry"))

    def emit(acc, r):
        moved = acc["s"].isNotNull() & _moves(acc["s"], r["code"])
        change = F.struct(r["t"].alias("t"), r["seq"].alias("seq"), r["code"].alias("code"),
                          acc["s"].alias("prev"), r["minute"].alias("minute"))
        return F.struct(F.when(acc["s"].isNull() | moved, r["code"]).otherwise(acc["s"]).alias("s"),
                        F.when(moved, F.array_append(acc["out"], change)).otherwise(acc["out"]).alias("out"))

    fields = "t:double,seq:bigint,code:bigint,prev:bigint,minute:int"
    start = F.struct(F.col("_entry").alias("s"), F.array().cast(f"array<struct<{fields}>>").alias("out"))
    shown = lambda c: F.concat_ws("-", F.floor(c / HOME), c % HOME)
    return (unnest(reads.join(entries, [*keys, "_b", "_s"]), keys, F.aggregate("rs", start, emit)["out"], "c")
            .select(*keys, "c.t", "c.seq", F.lit("scoreboard_ocr").alias("source"), F.lit(1.0).alias("strength"),
                    shown(F.col("c.code")).alias("score"), shown(F.col("c.prev")).alias("prev"), "c.minute"))
