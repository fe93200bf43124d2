"""Domain views over the given tables, for Spark and as SQL text for the check.

Each view is a function (spark, folder) -> DataFrame and a SQL body under the same name. Ordered Spark
views use the chunked helpers, so they hold for a user or order with very many rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import chunk_no, following, running_sum, with_position

US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
US_SQL = "(epoch_us(ts)-1704067200000000)"

SQL: dict[str, str] = {}
VIEWS: dict = {}


def view(name: str, sql: str):
    SQL[name] = sql

    def add(fn):
        VIEWS[name] = fn
        return fn
    return add


_SCHEMAS: dict = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the given tables; its schema is looked up in the files once per path."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_SIGNALS = """
  user_id as match_id, {us}/864e6 as t, event_id as seq,
  case event_type when 'click' then 'audio' when 'view' then 'scene' when 'purchase' then 'scoreboard_ocr'
                  when 'error' then 'commentary' else 'action_spotting' end as source,
  least(1e0, value/1e2) as strength,
  case when event_type='error'  then case event_id % 3 when 0 then 'goal' when 1 then 'chance' else 'card' end
       when event_type='signup' then case event_id % 5 when 0 then 'goal' when 1 then 'save' when 2 then 'card' when 3 then 'chance' else 'corner' end end as kind_hint,
  case when event_type='error' and event_id % 3 = 1 then case event_id % 2 when 0 then 'saved' else 'close' end end as phrase,
  case when event_type='purchase' then cast(floor({us}/864e6/60) as int) end as minute"""


@view("v_signals", f"select {_SIGNALS.format(us=US_SQL)} from events")
def signals(spark, d):
    return signals_of(spark, table(spark, d, "events"))


def signals_of(spark, events: DataFrame) -> DataFrame:
    return spark.sql(f"select {_SIGNALS.format(us=US)} from {{e}}", e=events)


# a match lasts to the end of the second of its last event
@view("v_durations", "select match_id, floor(max(t)) + 1e0 as duration from v_signals group by match_id")
def durations(spark, d):
    return signals(spark, d).groupBy("match_id").agg((F.floor(F.max("t")) + 1.0).alias("duration"))


@view("v_scenes", """select match_id, seq, t as start_s, coalesce(lead(t) over (partition by match_id order by t, seq), duration) as end_s
from v_signals join v_durations using (match_id)""")
def scenes(spark, d):
    rows = signals(spark, d).select("match_id", "t", "seq")
    return (following(rows, "match_id", ["t", "seq"], ["t"], bucket=chunk_no("t", 600.0)).join(durations(spark, d), "match_id")
            .select("match_id", "seq", F.col("t").alias("start_s"), F.coalesce("next_t", "duration").alias("end_s")))


@view("v_ocr", f"""select match_id, seq, t, concat('ABC ', cast(h + case event_id % 7 when 0 then 3 else 0 end as string), ' - ', cast(a as string), ' ', cast(cast(floor(t/60) as int) as string), '''') as text
from (select user_id as match_id, event_id, event_id as seq, {US_SQL}/864e6 as t,
        cast(sum(case when event_type='purchase' and event_id % 2 = 0 then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as h,
        cast(sum(case when event_type='purchase' and event_id % 2 = 1 then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as a
      from events) q""")
def ocr(spark, d):
    rows = spark.sql(f"""select user_id as match_id, event_id as seq, {US}/864e6 as t,
        cast(event_type='purchase' and event_id % 2 = 0 as int) as hp, cast(event_type='purchase' and event_id % 2 = 1 as int) as ap from {{e}}""",
                     e=table(spark, d, "events"))
    rows = running_sum(rows, "match_id", ["t", "seq"], {"h": F.col("hp"), "a": F.col("ap")}, bucket=chunk_no("t", 600.0))
    return rows.selectExpr("match_id", "seq", "t", """concat('ABC ', cast(h + case seq % 7 when 0 then 3 else 0 end as string), ' - ',
        cast(a as string), ' ', cast(cast(floor(t/60) as int) as string), '\\'') as text""")


_SPOTS = """user_id as match_id, event_id as seq, {us}/864e6 as t,
  case event_id % 6 when 0 then 'Goal' when 1 then 'Shots on target' when 2 then 'Save' when 3 then 'Yellow card' when 4 then 'Corner' else 'Throw-in' end as label,
  least(1e0, value/1e2) as conf"""


@view("v_spots", f"select {_SPOTS.format(us=US_SQL)} from events")
def spots(spark, d):
    return spark.sql(f"select {_SPOTS.format(us=US)} from {{e}}", e=table(spark, d, "events"))


_LOUD = "cast(floor(o_orderkey/1e3) as bigint) as match_id, o_orderkey % 1000 as idx, (o_orderkey % 1000)*5e-1 as t, o_totalprice/5e5 as rms"


@view("v_loudness", f"select {_LOUD} from orders")
def loudness(spark, d):
    return table(spark, d, "orders").selectExpr(*_split(_LOUD))


def _split(cols: str) -> list[str]:
    """Splits a select list at its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in cols:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


_SAMPLES = "cast(floor(o_orderkey/1e3) as bigint) as match_id, o_orderkey % 1000 as idx, o_totalprice/5e5 - 5e-1 as x"


@view("v_samples", f"select {_SAMPLES} from orders")
def samples(spark, d):
    return table(spark, d, "orders").selectExpr(*_split(_SAMPLES))


_FRAMES = """cast(floor(o_orderkey/1e3) as bigint) as match_id, o_orderkey % 1000 as idx,
  case cast(floor(o_orderkey/1e3) as bigint) % 3 when 0 then 25e0 when 1 then 0e0 else 2997e-2 end as fps"""


@view("v_match_frames", f"select {_FRAMES} from orders")
def match_frames(spark, d):
    return spark.sql(f"select {_FRAMES} from {{o}}", o=table(spark, d, "orders"))


@view("v_segments", "select conv_id as match_id, turn as seq, turn*15e0 as start_s, text from conversations")
def segments(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id as match_id", "turn as seq", "turn*15e0 as start_s", "text")


@view("v_words", """select conv_id as clip_id, turn, pos, word, turn*15e0 + pos*3e-1 as start_s, turn*15e0 + pos*3e-1 + 25e-2 as end_s
from (select conv_id, turn, unnest(range(len(w))) as pos, unnest(w) as word from (select *, string_split(text, ' ') as w from conversations) q) p""")
def words(spark, d):
    return spark.sql("""select conv_id as clip_id, turn, pos, word, turn*15e0 + pos*3e-1 as start_s, turn*15e0 + pos*3e-1 + 25e-2 as end_s
        from {c} lateral view posexplode(split(text, ' ')) w as pos, word""", c=table(spark, d, "conversations"))


# Tracks that lose a player now and then and ball detections with gaps are what the tracking operators are for: a frame
# without a detection has no row. A value near 0 stands for a detection below the confidence asked for.
_CLIP = "cast(floor(vec_id/5e1) as bigint) as clip_id, vec_id % 50 as frame"


@view("v_players", f"""select {_CLIP}, k as track_id, k as det_ord,
  960e0 + 8e2*cast(embedding[2*k+1] as double) as cx, 540e0 + 8e2*cast(embedding[2*k+2] as double) as cy
from (select vec_id, embedding, unnest(range(31)) as k from embeddings) q where abs(cast(embedding[2*k+1] as double)) >= 14e-3""")
def players(spark, d):
    return spark.sql(f"""select {_CLIP}, k as track_id, k as det_ord,
        960e0 + 8e2*cast(embedding[2*k] as double) as cx, 540e0 + 8e2*cast(embedding[2*k+1] as double) as cy
        from (select vec_id, embedding, explode(sequence(0L,30L)) as k from {{e}}) q where abs(cast(embedding[2*k] as double)) >= 14e-3""",
                     e=table(spark, d, "embeddings"))


@view("v_ball", f"""select {_CLIP}, 960e0 + 1e3*cast(embedding[63] as double) as ball_x, 540e0 + 8e2*cast(embedding[64] as double) as ball_y
from embeddings where abs(cast(embedding[62] as double)) >= 3e-2""")
def ball(spark, d):
    return spark.sql(f"""select {_CLIP}, 960e0 + 1e3*cast(embedding[62] as double) as ball_x, 540e0 + 8e2*cast(embedding[63] as double) as ball_y
        from {{e}} where abs(cast(embedding[61] as double)) >= 3e-2""", e=table(spark, d, "embeddings"))


# raw detections: three candidates per frame, of classes 0, 1, 2 (class 1 is the ball); now and then the third comes
# from the dedicated ball model; frames 20 to 29 of a clip show no ball
_DETS = """k as det_ord, case when k = 2 and vec_id % 4 = 0 and vec_id % 50 not between 20 and 29 then 'ball' else 'main' end as model,
  case when vec_id % 50 between 20 and 29 then 0 else (vec_id + k) % 3 end as class_id,
  round(abs(cast(embedding[{c}] as double)), 2) as conf,
  960e0 + 1e3*cast(embedding[{x}] as double) - 8e0 as x1, 540e0 + 8e2*cast(embedding[{y}] as double) - 8e0 as y1,
  960e0 + 1e3*cast(embedding[{x}] as double) + 8e0 as x2, 540e0 + 8e2*cast(embedding[{y}] as double) + 8e0 as y2"""


@view("v_dets", f"select {_CLIP}, {_DETS.format(c='k+11', x='2*k+21', y='2*k+22')} from (select vec_id, embedding, unnest(range(3)) as k from embeddings) q")
def dets(spark, d):
    body = _DETS.format(c="k+10", x="2*k+20", y="2*k+21")
    return spark.sql(f"select {_CLIP}, {body} from (select vec_id, embedding, explode(sequence(0L,2L)) as k from {{e}}) q",
                     e=table(spark, d, "embeddings"))


# classes of five detection models: each names its ball differently
_MODEL_NAMES = """concat('m', cast(r_regionkey as string)) as model_id, k as class_id,
  case when k = 1 + r_regionkey % 2 then concat('Ball of ', r_name) when k = 0 then 'player' else 'referee' end as name"""


@view("v_model_names", f"select {_MODEL_NAMES} from (select *, unnest(range(3)) as k from region) q")
def model_names(spark, d):
    return spark.sql(f"select {_MODEL_NAMES} from (select *, explode(sequence(0L, 2L)) as k from {{r}}) q", r=table(spark, d, "region"))


# jersey vectors of all players of a frame
_JERSEY = f"{_CLIP}, k as track_id, "


@view("v_features", f"select {_JERSEY} [cast(embedding[k+1] as double), cast(embedding[k+17] as double), cast(embedding[k+33] as double)] as f from (select vec_id, embedding, unnest(range(31)) as k from embeddings) q")
def features(spark, d):
    return spark.sql(f"""select {_JERSEY} array(cast(embedding[k] as double), cast(embedding[k+16] as double), cast(embedding[k+32] as double)) as feature
        from (select vec_id, embedding, explode(sequence(0L, 30L)) as k from {{e}}) q""", e=table(spark, d, "embeddings"))


@view("v_boxes", """select clip_id, frame, track_id, cx - 20e0 - track_id as x1, cy - 45e0 as y1, cx + 20e0 as x2, cy + 45e0 - track_id * 4 as y2 from v_players""")
def boxes(spark, d):
    return players(spark, d).selectExpr("clip_id", "frame", "track_id", "cx - 20e0 - track_id as x1", "cy - 45e0 as y1",
                                        "cx + 20e0 as x2", "cy + 45e0 - track_id * 4 as y2")


@view("v_clips", "select distinct cast(floor(vec_id/5e1) as bigint) as clip_id, 1920 as width, 1080 as height, 4e0 as fps, 50 as n_frames from embeddings")
def clips(spark, d):
    return (table(spark, d, "embeddings").selectExpr("cast(floor(vec_id/5e1) as bigint) as clip_id").distinct()
            .selectExpr("clip_id", "1920 as width", "1080 as height", "4e0 as fps", "50 as n_frames"))


@view("v_frames", f"select {_CLIP} from embeddings")
def frames(spark, d):
    return table(spark, d, "embeddings").selectExpr(*_split(_CLIP))


_H = "5e-2 + 1e-4*(vec_id % 50), 0e0, 2e0, 0e0, 6e-2, 1e0, 0e0, 1e-5, 1e0"


@view("v_homography", f"select {_CLIP}, case when vec_id % 4 <> 0 then list_value({_H}) end as h from embeddings")
def homography(spark, d):
    return spark.sql(f"select {_CLIP}, case when vec_id % 4 <> 0 then array({_H}) end as h from {{e}}", e=table(spark, d, "embeddings"))


# the side of the pitch a track keeps to tells its team; tracks all over it have none
@view("v_track_team", "select clip_id, track_id, case when avg(cx) < 96e1 then 0 else 1 end as team from v_players group by clip_id, track_id having abs(avg(cx) - 96e1) >= 5e0")
def track_team(spark, d):
    sides = players(spark, d).groupBy("clip_id", "track_id").agg(F.avg("cx").alias("x")).filter("abs(x - 96e1) >= 5e0")
    return sides.selectExpr("clip_id", "track_id", "cast(case when x < 96e1 then 0 else 1 end as int) as team")


@view("v_keypoints", f"""select {_CLIP}, cast(k as int) as kp_idx, 4e2 * cast(embedding[2*k+1] as double) as x, 4e2 * cast(embedding[2*k+2] as double) as y,
  abs(cast(embedding[k+41] as double)) * 5e0 as conf from (select vec_id, embedding, unnest(range(20)) as k from embeddings) q""")
def keypoints(spark, d):
    return spark.sql(f"""select {_CLIP}, k as kp_idx, 4e2 * cast(embedding[2*k] as double) as x, 4e2 * cast(embedding[2*k+1] as double) as y,
        abs(cast(embedding[k+40] as double)) * 5e0 as conf from (select vec_id, embedding, explode(sequence(0,19)) as k from {{e}}) q""",
                     e=table(spark, d, "embeddings"))


@view("v_track_labels", "select clip_id, frame, track_id, (frame // 7 + track_id + frame % 3) % 2 as label from v_players")
def track_labels(spark, d):
    return players(spark, d).selectExpr("clip_id", "frame", "track_id", "(frame div 7 + track_id + frame % 3) % 2 as label")


@view("v_reel_items", """select l_orderkey as reel_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as ord,
  l_quantity as duration, l_discount as confidence, case l_returnflag when 'A' then 'goal' when 'N' then 'chance' else 'card' end as kind from lineitem""")
def reel_items(spark, d):
    rows = with_position(table(spark, d, "lineitem"), "l_orderkey",
                         ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
                         bucket=chunk_no("l_linenumber", 1024), name="ord")
    return rows.selectExpr("l_orderkey as reel_id", "ord", "l_quantity as duration", "l_discount as confidence",
                           "case l_returnflag when 'A' then 'goal' when 'N' then 'chance' else 'card' end as kind")


@view("v_hsv", "select l_suppkey as owner, l_quantity*36e-1 as h, l_extendedprice % 256 as s from lineitem")
def hsv(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey as owner", "l_quantity*36e-1 as h", "l_extendedprice % 256 as s")


_FILES = "source as dir, concat(source, '/', cast(doc_id as string), case doc_id % 4 when 0 then '.MP4' when 1 then '.mkv' when 2 then '.txt' else '.mp4' end) as path, n_chars as size"


@view("v_files", f"select {_FILES} from documents")
def files(spark, d):
    return table(spark, d, "documents").selectExpr(*_split(_FILES))


_PROBE = """concat('{"format":{"duration":"', cast(o_orderkey % 97 as string), '.5"},"streams":[{"codec_type":"video","width":', cast(640 + o_orderkey % 3 * 640 as string), ',"height":720,"avg_frame_rate":"', case o_orderkey % 4 when 0 then '30000/1001' when 1 then '25/1' when 2 then '0/0' else '50' end, '"}', case o_orderkey % 2 when 0 then ',{"codec_type":"audio"}' else '' end, ']}') as js"""


@view("v_probe", f"select o_orderkey as media_id, {_PROBE} from orders")
def probe(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as media_id", _PROBE)


@view("v_log", "select doc_id as run_id, unnest(range(len(w))) as line_no, unnest(w) as line from (select *, string_split(text, chr(10)) as w from documents) q")
def log_lines(spark, d):
    return spark.sql(r"""select doc_id as run_id, cast(pos as bigint) as line_no, line from {t} lateral view posexplode(split(text, '\\n')) w as pos, line""",
                     t=table(spark, d, "documents"))


# class names of a detection model per brand: fantasy names where the part key is the class id
_NAMES = """p_brand as model_id, p_partkey as class_id,
  concat(case when p_size % 5 = 0 and p_brand < 'Brand#3' then 'Foot-Ball ' when p_size % 5 = 1 then 'goalKeeper ' when p_size % 5 = 2 and p_brand > 'Brand#2' then 'Player ' else 'referee ' end, p_type) as name"""


@view("v_class_names", f"select {_NAMES} from part")
def class_names(spark, d):
    return spark.sql(f"select {_NAMES} from {{p}}", p=table(spark, d, "part"))


# settings per customer nation: leaves under segment.balance paths, and overrides taken from the orders
@view("v_config_base", """select c_custkey as match_id, concat('render.', lower(c_mktsegment), '.', k) as path, concat(c_name, k) as value
from (select *, unnest(['fps', 'size.width', 'size.height']) as k from customer) q""")
def config_base(spark, d):
    return spark.sql("""select c_custkey as match_id, concat('render.', lower(c_mktsegment), '.', k) as path, concat(c_name, k) as value
        from (select *, explode(array('fps', 'size.width', 'size.height')) as k from {c}) q""", c=table(spark, d, "customer"))


_OVER = """select match_id, path, max(value) as value from (
  select o_custkey as match_id, case o_orderkey % 4
      when 0 then concat('render.', lower(c_mktsegment), '.fps') when 1 then concat('render.', lower(c_mktsegment), '.size')
      when 2 then concat('render.', lower(c_mktsegment), '.fps.max') else concat('audio.', lower(o_orderpriority)) end as path,
    concat('o', cast(o_orderkey as string)) as value
  from {o} join {c} on o_custkey = c_custkey) q group by match_id, path"""


@view("v_config_over", _OVER.format(o="orders", c="customer"))
def config_over(spark, d):
    return spark.sql(_OVER, o=table(spark, d, "orders"), c=table(spark, d, "customer"))


@view("v_clip_results", """select o_custkey as match_id, o_orderkey as clip_no, case o_orderkey % 3 when 0 then 'goal' when 1 then 'chance' else 'card' end as kind,
  case o_orderstatus when 'F' then 'failed' else 'ok' end as status, case o_orderstatus when 'F' then 'track' end as stage_failed from orders""")
def clip_results(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_custkey as match_id", "o_orderkey as clip_no", "case o_orderkey % 3 when 0 then 'goal' when 1 then 'chance' else 'card' end as kind",
        "case o_orderstatus when 'F' then 'failed' else 'ok' end as status", "case o_orderstatus when 'F' then 'track' end as stage_failed")


@view("v_timed_clips", """select reel_id, ord, duration, kind, confidence, duration * confidence * 1e1 as key_t from v_reel_items""")
def timed_clips(spark, d):
    return reel_items(spark, d).selectExpr("reel_id", "ord", "duration", "kind", "confidence", "duration * confidence * 1e1 as key_t")


@view("v_moment_rows", """select match_id, t, strength as confidence, seq, case seq % 4 when 0 then 'goal' when 1 then 'chance' when 2 then 'skill' else 'save' end as kind from v_signals""")
def moment_rows(spark, d):
    return signals(spark, d).selectExpr("match_id", "t", "strength as confidence", "seq",
                                        "case seq % 4 when 0 then 'goal' when 1 then 'chance' when 2 then 'skill' else 'save' end as kind")


@view("v_times", """select conv_id as clip_id, turn, k as shot, turn*15e0 + k*7e-1 as t from (select conv_id, turn, unnest(range(5)) as k from conversations) q""")
def times(spark, d):
    return spark.sql("""select conv_id as clip_id, turn, k as shot, turn*15e0 + k*7e-1 as t
        from (select conv_id, turn, explode(sequence(0L, 4L)) as k from {c}) q""", c=table(spark, d, "conversations"))


_EVENT_TIMES = """select reel_id, ord, k as mark, duration * k / 4e0 as event_t from ({src}) q"""


@view("v_clip_events", _EVENT_TIMES.format(src="select *, unnest(range(5)) as k from v_timed_clips"))
def clip_events(spark, d):
    rows = timed_clips(spark, d).withColumn("mark", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return rows.select("reel_id", "ord", "mark", (F.col("duration") * F.col("mark") / 4.0).alias("event_t"))


_OVERLAY_IN = """reel_id, ord, kind, case when ord % 2 = 0 then cast(ord * 10 as int) end as minute, case kind when 'goal' then 'Rate it' when 'chance' then '' end as hook,
  case ord % 3 when 0 then true when 1 then false end as metric, duration * 7e-1 as sprint_distance_m, case when ord % 3 = 0 then duration * 9e-1 end as top_speed_kmh,
  duration % 10 / 2e0 as shot_distance_m, case when ord <> 3 then ord end as players_beaten"""


@view("v_overlay_in", f"select {_OVERLAY_IN} from v_reel_items")
def overlay_in(spark, d):
    return spark.sql(f"select {_OVERLAY_IN} from {{r}}", r=reel_items(spark, d))


# numbers as texts; some are spoiled, and so are all of some matches
_RAW = "user_id as match_id, case when user_id % 50 = 49 then 'n/a' when event_id % 9 = 0 then concat('x', cast(value as string)) else cast(value as string) end as raw"


@view("v_raw_values", f"select {_RAW} from events")
def raw_values(spark, d):
    return table(spark, d, "events").selectExpr(*_split(_RAW))
