"""All registered queries: name -> (Spark plan over a data folder, check SQL or None)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..config import LOG_KEYWORDS, AudioConfig, MomentConfig, config_hash, pitch_landmarks
from ..functions.ordered import chunk_no
from ..operators import audio, captions, commentary, effects, fusion, overlays, pitch, reel, reframe, scenes, scoreboard
from ..operators import stats, teams, telestration, tracking
from ..plans import highlights
from ..sources import logs, media, state
from ..streaming import live, replay
from . import oracles as o
from . import views as v
from .oracles import r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Thresholds at which the given tables yield results (random prices rarely reach the default)
AUDIO = AudioConfig(threshold=1.5)
KEYWORDS = {"goal": ["the", "tion"], "chance": ["on", "en"], "card": ["ch"]}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if sql.startswith("with recursive") else o.sql(sql)
        return fn
    return add


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- sources -------------------------------------------------------------------------------------------
@query("probe_media", """select media_id, (media_id % 97) + 5e-1 as duration, cast(json_extract_string(js, '$.streams[0].width') as int) as width,
  cast(json_extract_string(js, '$.streams[0].height') as int) as height,
  round(case json_extract_string(js, '$.streams[0].avg_frame_rate') when '30000/1001' then 30000 / 1001e0 when '25/1' then 25e0 when '0/0' then 30e0 else 50e0 end, 6) as fps,
  coalesce(json_extract_string(js, '$.streams[1].codec_type') = 'audio', false) as has_audio from v_probe""")
def _probe_media(spark, d):
    return _r6(media.probe_media(v.probe(spark, d)), "fps")


HASH = config_hash(MomentConfig())


def _done(spark, d):
    return v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("match_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(HASH)).otherwise(F.lit("stale")).alias("config_hash"))


@query("pending_matches", f"""select distinct user_id as match_id from events where user_id not in (
  select c_custkey from (select c_custkey, case when c_custkey % 3 = 0 then '{HASH}' else 'stale' end as config_hash from customer) q where config_hash = '{HASH}')""")
def _pending(spark, d):
    return state.pending(v.durations(spark, d).select("match_id"), _done(spark, d), config_hash=HASH)


def _documents_sql(mode):
    return f"""select match_id, cast(to_json({{match_id: match_id, moments: count(*), goals: count(*) filter (where kind = 'goal'), n_ok: count(*) filter (where status = 'ok'), n_failed: count(*) filter (where status = 'failed'),
  status: case when count(*) filter (where status = 'ok') > 0 then 'ok' else 'failed' end, mode: '{mode}',
  clips: list({{clip_no: clip_no, kind: kind, confidence: confidence, t: round(t, 3), minute: minute, status: status}} order by clip_no)}}) as string) as document from o_cut_status group by match_id"""


def _with_status(df):
    return df.withColumn("status", F.when(F.floor("t") % 5 == 0, "failed").otherwise("ok"))


@query("run_result_json", _documents_sql("per_clip"))
def _documents(spark, d, mode="per_clip"):
    clips = _with_status(_cuts(spark, d)).withColumn("t", F.round("t", 3))
    return state.result_documents(overlays.run_summary(clips, mode=mode), clips)


@query("run_result_compilation", _documents_sql("compilation"))
def _documents_compilation(spark, d):
    return _documents(spark, d, "compilation")


@query("missing_files", "select path from v_files where coalesce(size, 0) % 3 = 0 or coalesce(size, 0) % 5 = 0")
def _missing(spark, d):
    files = v.files(spark, d).withColumn("size", F.coalesce(F.col("size"), F.lit(0)))
    present = files.filter("size % 3 <> 0").withColumn("size", F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("size")))
    return state.missing_files(files.select("path"), present)


@query("load_or_compute", "select match_id, count(*) as n_signals from v_signals group by match_id")
def _resume(spark, d):
    """Some matches are saved by a first run; the second loads them and works out the others."""
    signals, path = v.signals(spark, d), f"{state.shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    keys = v.durations(spark, d).select("match_id")

    def compute(left):
        return signals.join(left, "match_id", "left_semi").groupBy("match_id").agg(F.count(F.lit(1)).alias("n_signals"))

    state.load_or_compute(spark, path, keys.filter("match_id % 2 = 0"), compute, config_hash=HASH)
    return state.load_or_compute(spark, path, keys, compute, config_hash=HASH).drop("config_hash")


@query("saved_captions", f"select match_id, seq, {o.CAPTION} as caption from v_moment_rows")
def _saved_captions(spark, d):
    path = f"{state.shared_folder(spark)}/captions-{uuid.uuid4().hex}"
    state.write_captions(_clip_caption(spark, d), path, by=["match_id", "seq"], buckets=8)
    return spark.read.schema("match_id long, seq long, caption string").json(path).select("match_id", "seq", "caption")


@query("list_inputs", """select dir, concat(dir, '/', name) as path, size from (select source as dir, concat(cast(doc_id as string), case doc_id % 4 when 0 then '.MP4' when 1 then '.mkv' when 2 then '.txt' else '.mp4' end) as name,
    octet_length(encode(coalesce(text, ''))) + 1 as size from documents where source is not null) q
  where regexp_matches(lower(name), '\\.(mp4|mkv|mov|m4v|avi|webm|ts)$') order by path""")
def _list_inputs(spark, d):
    """The documents are saved as files, and the files on disk are listed."""
    path = f"{state.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    media.save_files(v.table(spark, d, "documents").filter("source is not null").selectExpr(
        "source as dir", "concat(cast(doc_id as string), case doc_id % 4 when 0 then '.MP4' when 1 then '.mkv' when 2 then '.txt' else '.mp4' end) as name",
        "coalesce(text, '') as body"), path)
    return media.list_inputs(media.read_file_catalog(spark, path))


@query("list_outputs", """select dir, path, size, case when lower(path) like '%.mp4' then 0 else 1 end as rank from v_files
  where lower(path) like '%.mp4' or lower(path) like '%.txt' order by dir, rank, path""")
def _list_outputs(spark, d):
    return media.list_outputs(v.files(spark, d))


@query("delete_matches", "select * from v_files where dir not in (select source from documents where lang = 'de' and n_chars > 9000)")
def _delete_matches(spark, d):
    """Rows saved in two steps, and deleted by a new version."""
    files, store = v.files(spark, d), state.Store(spark, f"{state.shared_folder(spark)}/files-{uuid.uuid4().hex}")
    video = F.col("path").endswith(".txt")
    store.append(files.filter(video))
    store.append(files.filter(~video))
    store.delete(v.table(spark, d, "documents").filter("lang = 'de' and n_chars > 9000").select(F.col("source").alias("dir")), by="dir")
    return store.read()


@query("file_manifest", """select dir, path, cast(grouping(dir) * 2 + grouping(path) as int) as level, round(sum(size) / 1e6, 6) as mb
  from v_files group by rollup(dir, path)""")
def _manifest(spark, d):
    return _r6(media.file_manifest(v.files(spark, d)), "mb")


_FLAG = " or ".join(f"contains(lower(line), '{w}')" for w in (*LOG_KEYWORDS, "tion", "sch"))


@query("triage_log", f"""select run_id, line_no, line, true as flagged from (
    select run_id, line, min(line_no) as line_no, row_number() over (partition by run_id order by min(line_no) desc) as r from v_log where {_FLAG} group by run_id, line) q where r <= 12
  union all select run_id, line_no, line, false from (select *, row_number() over (partition by run_id order by line_no desc) as r from v_log) q
  where r <= 12 and run_id not in (select run_id from v_log where {_FLAG})""")
def _triage(spark, d):
    # the prose holds few of the default words, so two of its syllables are added
    return logs.triage_log(v.log_lines(spark, d), keywords=(*LOG_KEYWORDS, "tion", "sch"))


# ---- row-wise ------------------------------------------------------------------------------------------
@query("sample_frames", """select match_id, idx, fps, round(idx / case when fps = 0 then 25e0 else fps end, 6) as t from v_match_frames
  where idx % cast(floor(greatest(1e0, 5e0 * case when fps = 0 then 25e0 else fps end)) as int) = 0""")
def _sample_frames(spark, d):
    return _r6(scoreboard.sample_frames(v.match_frames(spark, d)), "t")


@query("roi_box", """select media_id, width, height, 0 as roi_x1, 0 as roi_y1, cast(floor(width * 55e-2) as int) as roi_x2, cast(floor(height * 18e-2) as int) as roi_y2
  from (select media_id, cast(json_extract_string(js, '$.streams[0].width') as int) as width, cast(json_extract_string(js, '$.streams[0].height') as int) as height from v_probe) q""")
def _roi(spark, d):
    return scoreboard.roi_box(media.probe_media(v.probe(spark, d)).select("media_id", "width", "height"))


@query("stride", "select clip_id, frame from v_frames where frame % 3 = 0")
def _stride(spark, d):
    return scoreboard.stride(v.frames(spark, d), 3)


@query("letterbox", """select media_id, width, height, w as scaled_w, h as scaled_h, cast((1080 - w) // 2 as int) as pad_x, cast((1920 - h) // 2 as int) as pad_y from (
  select *, least(1080, cast(round(1920 * width / height) as int)) as w, least(1920, cast(round(1080 * height / width) as int)) as h from (
    select media_id, cast(json_extract_string(js, '$.streams[0].width') as int) as width, cast(json_extract_string(js, '$.streams[0].height') as int) as height from v_probe) q) r""")
def _letterbox(spark, d):
    return reframe.letterbox(media.probe_media(v.probe(spark, d)).select("media_id", "width", "height"))


@query("parse_score", "select match_id, seq, home, away from o_read")
def _parse_score(spark, d):
    return scoreboard.read_scores(v.ocr(spark, d)).select("match_id", "seq", "home", "away")


@query("parse_minute", "select match_id, seq, minute from o_read")
def _parse_minute(spark, d):
    return scoreboard.read_scores(v.ocr(spark, d)).select("match_id", "seq", "minute")


def _first_word(words):
    return "case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in words) + " end"


@query("keyword_signals", "select match_id, seq, start_s as t, 'commentary' as source, strength, kind_hint, phrase, text from (" + " union all ".join(
    f"select match_id, seq, start_s, '{k}' as kind_hint, {7 if k == 'goal' else 5}e-1 as strength, {_first_word(w)} as phrase, "
    rf"substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 120) as text from v_segments" for k, w in KEYWORDS.items()) + ") q where phrase is not null")
def _keywords(spark, d):
    return commentary.keyword_signals(v.segments(spark, d), KEYWORDS)


@query("spot_signals", """select match_id, seq, t, 'action_spotting' as source, least(1e0, conf) as strength,
  case lower(label) when 'goal' then 'goal' when 'shots on target' then 'chance' when 'save' then 'save' when 'yellow card' then 'card' else 'skill' end as kind_hint, label
  from v_spots where conf >= 5e-1 and label <> 'Throw-in'""")
def _spots(spark, d):
    return commentary.spot_signals(v.spots(spark, d), {"corner": "skill"}).select(
        "match_id", "seq", "t", "source", "strength", "kind_hint", "label")


@query("resolve_classes", """select model_id, case when contains(lower(name), 'ball') then 'ball' else 'player' end as role, class_id from v_class_names
    where contains(lower(name), 'ball') or contains(lower(name), 'player') or contains(lower(name), 'keeper')
  union all select model_id, 'ball', 32 from v_class_names group by model_id having not bool_or(contains(lower(name), 'ball'))
  union all select model_id, 'player', 0 from v_class_names group by model_id
    having not bool_or(not contains(lower(name), 'ball') and (contains(lower(name), 'player') or contains(lower(name), 'keeper')))""")
def _classes(spark, d):
    return tracking.resolve_classes(v.class_names(spark, d))


@query("torso_box", """select clip_id, frame, track_id, greatest(0, x1) as tx1, greatest(0, y1 + cast(trunc(2e-1 * (y2 - y1)) as int)) as ty1,
  greatest(0, x2) as tx2, greatest(0, y1 + cast(trunc(55e-2 * (y2 - y1)) as int)) as ty2
  from (select clip_id, frame, track_id, cast(trunc(x1) as int) as x1, cast(trunc(y1) as int) as y1, cast(trunc(x2) as int) as x2, cast(trunc(y2) as int) as y2 from v_boxes) q
  where greatest(0, x2) > greatest(0, x1)
    and greatest(0, y1 + cast(trunc(55e-2 * (y2 - y1)) as int)) > greatest(0, y1 + cast(trunc(2e-1 * (y2 - y1)) as int))""")
def _torso(spark, d):
    return teams.torso_box(v.boxes(spark, d)).select("clip_id", "frame", "track_id", "tx1", "ty1", "tx2", "ty2")


@query("to_pitch", f"""select clip_id, frame, track_id, {r6('px', 'py')} from (
  select p.clip_id, p.frame, p.track_id, case when h is not null then (h[1] * cx + h[2] * cy + h[3]) / (h[7] * cx + h[8] * cy + h[9]) end as px,
    case when h is not null then (h[4] * cx + h[5] * cy + h[6]) / (h[7] * cx + h[8] * cy + h[9]) end as py
  from v_players p left join v_homography m using (clip_id, frame)) q""")
def _to_pitch(spark, d):
    return _r6(pitch.to_pitch(v.players(spark, d), v.homography(spark, d)).select("clip_id", "frame", "track_id", "px", "py"), "px", "py")


@query("loudness_db", f"select match_id, idx, {r6('db')} from o_db")
def _loudness(spark, d):
    return _r6(audio.loudness_db(v.loudness(spark, d)).select("match_id", "idx", "db"), "db")


@query("config_overlay", """select coalesce(b.match_id, u.match_id) as match_id, coalesce(b.path, u.path) as path, case when u.path is not null then u.value else b.value end as value,
    u.path is not null as overridden
  from (select * from v_config_base b where not exists (select 1 from v_config_over x where x.match_id = b.match_id
      and (starts_with(x.path, concat(b.path, '.')) or starts_with(b.path, concat(x.path, '.'))))) b
  full outer join v_config_over u on u.match_id = b.match_id and u.path = b.path""")
def _config(spark, d):
    return overlays.config_overlay(v.config_base(spark, d), v.config_over(spark, d))


_DOCS = """select c_custkey as match_id, concat('{"name":"', c_name, '","render":{"tags":["a",', c_custkey % 7, '],"', lower(c_mktsegment), '":{"fps":', c_custkey % 60, ',"size":{"width":640,"height":', c_custkey % 9, '}}}}') as settings
  from customer"""
_OVER_DOCS = """select o_custkey as match_id, max(concat(case o_orderkey % 4 when 0 then concat('{"render":{"', lower(c_mktsegment), '":{"fps":', o_orderkey, '}}}')
    when 1 then concat('{"render":{"', lower(c_mktsegment), '":{"size":', o_orderkey, '},"tags":[', o_orderkey, ']}}')
    when 2 then concat('{"render":{"', lower(c_mktsegment), '":{"fps":{"max":', o_orderkey, ',"min":{}}}}}') else '{"audio":{"gain":[1,{"x":2}]},"name":{}}' end)) as settings
  from orders join customer on o_custkey = c_custkey group by o_custkey"""


@query("merged_documents", f"""select match_id, replace(fullkey, '$.', '') as path, cast(value as varchar) as value
  from (select coalesce(b.match_id, u.match_id) as match_id, json_merge_patch(coalesce(b.settings, '{{}}')::json, coalesce(u.settings, '{{}}')::json) as j
        from ({_DOCS}) b full join ({_OVER_DOCS}) u on b.match_id = u.match_id) q, json_tree(j)
  where (type <> 'OBJECT' or cast(value as varchar) = '{{}}') and fullkey not like '%[%'""")
def _merged_documents(spark, d):
    """Nested documents go in and come out; their leaves are compared."""
    names = ("customer", "orders")

    def read(sql):
        sql = sql.replace("{", "{{").replace("}", "}}")
        for name in names:
            sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
        return spark.sql(sql, **{name: v.table(spark, d, name) for name in names if f"{{{name}}}" in sql}).withColumn("settings", F.parse_json("settings"))

    merged = overlays.merge_documents(read(_DOCS), read(_OVER_DOCS))
    leaves, _ = overlays.document_leaves(merged)
    return leaves.select("match_id", F.array_join("path", ".").alias("path"), F.to_json("value").alias("value"))


# ---- windows -------------------------------------------------------------------------------------------
@query("rms_envelope", f"""select h.match_id, h.hop_no, {r6('sqrt(sum(coalesce(x * x, 0)) / 20)').replace('as sqrt(sum(coalesce(x * x, 0)) / 20)', 'as rms')}
  from o_hops h left join v_samples s on s.match_id = h.match_id and s.idx between h.hop_no * 8 - 10 and h.hop_no * 8 + 9 group by h.match_id, h.hop_no""")
def _rms(spark, d):
    return _r6(audio.rms_envelope(v.samples(spark, d), frame=20, hop=8), "rms")


@query("moving_avg", f"select match_id, idx, {r6('smooth')} from o_smooth")
def _moving(spark, d):
    return _r6(audio.moving_avg(audio.loudness_db(v.loudness(spark, d)), "db", 6).select("match_id", "idx", "smooth"), "smooth")


@query("loudness_zscore", f"select match_id, idx, {r6('z')} from o_z")
def _z(spark, d):
    smooth = audio.moving_avg(audio.loudness_db(v.loudness(spark, d)), "db", AUDIO.smooth_rows)
    return _r6(audio.rolling_z(smooth, "smooth", AUDIO.baseline_rows).select("match_id", "idx", "z"), "z")


def _z_frames(spark, d):
    return audio.smoothed_z(audio.loudness_db(v.loudness(spark, d)), "db", smooth=AUDIO.smooth_rows, baseline=AUDIO.baseline_rows, keep_chunk=True)


@query("audio_peaks", f"select match_id, idx, t, {r6('z')}, n from o_peaks")
def _peaks(spark, d):
    return _r6(audio.audio_peaks(_z_frames(spark, d), thr=AUDIO.threshold), "z")


@query("merge_peaks", f"select match_id, t, {r6('z')} from o_merged")
def _merge(spark, d):
    return _r6(audio.merge_peaks(audio.audio_peaks(_z_frames(spark, d), thr=AUDIO.threshold)), "z")


@query("replay_clusters", """select match_id, min(start_s) as t, 'scene' as source, least(1e0, count(*) / 6e0) as strength, count(*) as short_scenes
  from (select *, pos - row_number() over (partition by match_id order by pos) as run from (
      select *, row_number() over (partition by match_id order by start_s, seq) as pos from v_scenes) q where end_s - start_s <= 3e1) r
  group by match_id, run having count(*) >= 3""")
def _replays(spark, d):
    return scenes.replay_clusters(v.scenes(spark, d), max_s=30.0)


@query("cluster_signals", "select match_id, t, seq, source, cluster from o_clustered")
def _clustered(spark, d):
    return fusion.cluster_signals(v.signals(spark, d)).select("match_id", "t", "seq", "source", "cluster")


@query("ball_trail", """select clip_id, frame, k as segment, cast(trunc(pts[k].x) as int) as x0, cast(trunc(pts[k].y) as int) as y0,
    cast(trunc(pts[k + 1].x) as int) as x1, cast(trunc(pts[k + 1].y) as int) as y1, greatest(1, cast(floor(4e0 * k / n) as int)) as thickness
  from (select *, unnest(range(1, n)) as k from (select clip_id, frame, list({x: ball_x, y: ball_y}) over w as pts, count(*) over w as n
    from o_path window w as (partition by clip_id order by frame rows 17 preceding)) q) r""")
def _trail(spark, d):
    return telestration.ball_trail(_path(spark, d))


@query("motion_path", f"select clip_id, frame, point, {r6('x', 'y')} from (select clip_id, frame, unnest(range(n)) as point, unnest(list_transform(pts, lambda p: p.x)) as x, unnest(list_transform(pts, lambda p: p.y)) as y from o_motion) q")
def _motion(spark, d):
    return _r6(telestration.motion_path(_key_path(spark, d), v.frames(spark, d), smooth=False), "x", "y")


_MIRROR = "case when abs(i - k // 2 + j) >= n then 2 * (n - 1) - abs(i - k // 2 + j) else abs(i - k // 2 + j) end"


@query("motion_path_smoothed", f"""select clip_id, frame, point, {r6('x', 'y')} from (
  select clip_id, frame, i as point, sum(pts[{_MIRROR} + 1].x) / k as x, sum(pts[{_MIRROR} + 1].y) / k as y
  from (select *, unnest(range(k)) as j from (select *, greatest(1, n // 6) as k, unnest(range(n)) as i from o_motion) q) r group by clip_id, frame, i, k) s""")
def _motion_smooth(spark, d):
    return _r6(telestration.motion_path(_key_path(spark, d), v.frames(spark, d)), "x", "y")


@query("players_beaten", "select * from o_beaten")
def _beaten(spark, d):
    return stats.players_beaten(v.players(spark, d), _key(spark, d))


@query("carry_forward", """select clip_id, frame, """ + ", ".join(f"round(h[{i + 1}], 6) as h{i}" for i in range(9)) +
       " from (select clip_id, frame, last_value(h ignore nulls) over (partition by clip_id order by frame) as h from v_homography) q")
def _carry(spark, d):
    return _flat_h(pitch.carry_forward(v.homography(spark, d)))


def _flat_h(df):
    return df.select("clip_id", "frame", *[F.round(F.col("h")[i], 6).alias(f"h{i}") for i in range(9)])


@query("interpolate_ball", f"select clip_id, frame, {r6('ball_x', 'ball_y')}, filled from o_path")
def _interpolate(spark, d):
    return _r6(_path(spark, d), "ball_x", "ball_y")


@query("round_robin", f"""select match_id, kind, t, seq, list_extract({o.HOOKS}, cast((row_number() over (partition by match_id, kind order by t, seq) - 1) % len({o.HOOKS}) as int) + 1) as hook,
  list_extract(['a.mp3', 'b.wav', 'c.aac'], cast((row_number() over (partition by match_id order by t, seq) - 1) % 3 as int) + 1) as track from v_moment_rows""")
def _rotate(spark, d):
    from ..config import BrandConfig
    rows = v.moment_rows(spark, d).select("match_id", "kind", "t", "seq")
    hooked = captions.round_robin(rows, BrandConfig().hooks, order=("t", "seq"), bucket=chunk_no("t", 600.0), name="hook")
    return captions.round_robin(hooked, ["a.mp3", "b.wav", "c.aac"], by="match_id", order=("t", "seq"), bucket=chunk_no("t", 600.0), name="track")


def _lines(spark, d):
    words = v.words(spark, d).withColumn("word", F.concat(F.lit(" "), F.col("word")))
    return captions.caption_lines(words)


@query("caption_lines", f"select clip_id, line_no, text, {r6('start_s', 'end_s')} from o_lines")
def _caption_lines(spark, d):
    return _r6(_lines(spark, d), "start_s", "end_s")


# every fifth line is blanked, to see that numbers keep counting
@query("caption_schedule", """select clip_id, no as draw_no, text, printf('%.2f', start_s) as from_s, printf('%.2f', end_s) as to_s from (
  select *, row_number() over (partition by clip_id order by line_no) - 1 as no from o_lines) q where line_no % 5 <> 3 and text <> ''""")
def _caption_schedule(spark, d):
    blank = _lines(spark, d).withColumn("text", F.when(F.col("line_no") % 5 == 3, F.lit(" \t")).otherwise(F.col("text")))
    return captions.caption_schedule(blank, numbered=True)


# ---- joins ---------------------------------------------------------------------------------------------
@query("captions_at", f"select t.clip_id, t.turn, t.shot, {r6('t.t')}, l.line_no, l.text from v_times t join o_lines l on l.clip_id = t.clip_id and t.t between l.start_s and l.end_s")
def _captions_at(spark, d):
    return _r6(captions.captions_at(v.times(spark, d), _lines(spark, d)).select("clip_id", "turn", "shot", "t", "line_no", "text"), "t")


@query("signals_in_moments", "select s.match_id, s.t, s.seq, s.source, m.t as moment_t, m.kind from v_signals s join o_moments m on m.match_id = s.match_id and s.t between m.start_s and m.end_s")
def _in_moments(spark, d):
    return fusion_moments_join(spark, d)


def fusion_moments_join(spark, d):
    return captions.signals_in_moments(v.signals(spark, d), _moments(spark, d)).select("match_id", "t", "seq", "source", "moment_t", "kind")


_MARKS = "(values " + ", ".join(f"({i}, '{n}', {x!r}::double, {y!r}::double)" for i, n, x, y in pitch_landmarks()) + ") as l(kp_idx, name, px, py)"


@query("keypoint_matches", f"""select * from (select k.clip_id, k.frame, k.kp_idx, l.name, {r6('x', 'y', 'px', 'py')}, count(*) over (partition by clip_id, frame) as n_points
  from v_keypoints k join {_MARKS} using (kp_idx) where conf >= 5e-1 and x + y > 0) q where n_points >= 4""")
def _keypoints(spark, d):
    rows = pitch.keypoint_matches(v.keypoints(spark, d))
    return _r6(rows.select("clip_id", "frame", "kp_idx", "name", "x", "y", "px", "py", "n_points"), "x", "y", "px", "py")


# ---- aggregations --------------------------------------------------------------------------------------
@query("fuse_confidence", f"select match_id, first_t, signal_count, {r6('conf')}, sources from o_labelled")
def _fuse(spark, d):
    fused = fusion.fuse_confidence(fusion.clusters(v.signals(spark, d)))
    return fused.select("match_id", "first_t", "signal_count", F.round("confidence", 6).alias("conf"),
                        F.array_join("sources", ",").alias("sources"))


def _fused(spark, d):
    return fusion.fuse_confidence(fusion.clusters(v.signals(spark, d)))


@query("classify_clusters", "select match_id, first_t, kind from o_labelled")
def _classify(spark, d):
    return fusion.classify_clusters(_fused(spark, d)).select("match_id", "first_t", "kind")


@query("anchor_moments", "select match_id, first_t, t, minute from o_labelled")
def _anchor(spark, d):
    return fusion.anchor_moments(_fused(spark, d)).select("match_id", "first_t", "t", "minute")


@query("best_ball", f"select clip_id, frame, {r6('ball_x', 'ball_y')}, conf, model from o_best_ball")
def _best_ball(spark, d):
    return _r6(_balls(spark, d), "ball_x", "ball_y")


def _balls(spark, d):
    return tracking.best_ball(_dets(spark, d), _det_classes(spark, d))


def _dets(spark, d):
    return v.dets(spark, d).withColumn("model_id", F.concat(F.lit("m"), (F.col("clip_id") % 5).cast("string")))


def _det_classes(spark, d):
    return tracking.resolve_classes(v.model_names(spark, d))


@query("key_player", "select * from o_key")
def _key_query(spark, d):
    return tracking.key_player(v.players(spark, d), v.ball(spark, d), v.clips(spark, d))


def _key(spark, d):
    return _key_query(spark, d).select("clip_id", "key_track_id")


def _key_path(spark, d):
    return telestration.key_path(v.players(spark, d), _key(spark, d))


def _path(spark, d):
    return tracking.interpolate_ball(v.ball(spark, d))


@query("key_player_possession", "select * from o_poss")
def _possession(spark, d):
    return tracking.key_player_possession(v.players(spark, d), v.ball(spark, d), v.clips(spark, d), v.track_team(spark, d))


@query("team_vote", """select clip_id, track_id, first(label order by n desc, since) as team, cast(sum(n) as bigint) as n from (
  select clip_id, track_id, label, count(*) as n, min(frame) as since from v_track_labels group by all) q group by all""")
def _team_vote(spark, d):
    return teams.team_vote(v.track_labels(spark, d))


@query("jersey_hist", """select owner, bin, round(coalesce(c / norm, 0e0), 6) as value from (
  select g.owner, g.bin, c, sqrt(sum(c * c) over (partition by g.owner)) as norm
  from (select owner, unnest(range(128)) as bin from (select distinct owner from v_hsv) q) g
  left join (select owner, cast(floor(h * 16 / 180) * 8 + floor(s * 8 / 256) as bigint) as bin, count(*) as c from v_hsv where h >= 0 and h < 180 and s >= 0 and s < 256 group by all) b
  using (owner, bin)) r""")
def _hist(spark, d):
    return _r6(teams.jersey_hist(v.hsv(spark, d)), "value").withColumn("bin", F.col("bin").cast("long"))


@query("calib_coverage", "select * from o_coverage")
def _coverage(spark, d):
    return pitch.calib_coverage(v.homography(spark, d))


@query("run_summary", """select match_id, moments, goals, n_ok, n_failed, case when moments = 0 then 'empty' when n_ok > 0 then 'ok' else 'failed' end as status, 'per_clip' as mode from (
  select c_custkey as match_id, count(r.match_id) as moments, count(*) filter (where r.kind = 'goal') as goals, count(*) filter (where r.status = 'ok') as n_ok, count(*) filter (where r.status = 'failed') as n_failed
  from customer left join v_clip_results r on r.match_id = c_custkey group by c_custkey) q""")
def _summary(spark, d):
    runs = v.table(spark, d, "customer").select(F.col("c_custkey").alias("match_id"))
    return overlays.run_summary(v.clip_results(spark, d), runs)


# ---- folds ---------------------------------------------------------------------------------------------
@query("score_changes", o.CHANGES.format(fold="o_score"))
def _changes(spark, d):
    return scoreboard.score_changes(scoreboard.read_scores(v.ocr(spark, d)))


@query("select_reel", "select reel_id, ord, duration, confidence, kind, slot from o_chosen")
def _reel(spark, d):
    return reel.select_reel(v.reel_items(spark, d)).select("reel_id", "ord", "duration", "confidence", "kind", "slot")


@query("camera_path", """select clip_id, frame, round(x, 6) as cx, cast(round_even(x - 304, 0) as bigint) as x0, 608::bigint as crop_w
  from (select clip_id, frame, least(greatest(cx, 304e0), 1920 - 304e0) as x from o_cam) q""")
def _camera(spark, d):
    return _r6(reframe.camera_path(v.frames(spark, d), v.players(spark, d), _path(spark, d), v.clips(spark, d)), "cx")


@query("camera_center", "select clip_id, frame, 960e0 as cx, cast(960 - 540 as bigint) as x0, 1080::bigint as crop_w from v_frames")
def _camera_center(spark, d):
    return reframe.camera_path(v.frames(spark, d), v.players(spark, d), _path(spark, d), v.clips(spark, d), aspect="1:1", mode="center")


@query("smooth_homography", """select clip_id, frame, """ + ", ".join(f"round(h[{i + 1}], 6) as h{i}" for i in range(9)) + " from o_hema")
def _smooth_h(spark, d):
    return _flat_h(pitch.smooth_homography(v.homography(spark, d)))


# ---- stats ---------------------------------------------------------------------------------------------
@query("pixel_distance", f"select clip_id, {r6('sprint_distance_m')} from o_px_run")
def _px_run(spark, d):
    return _r6(stats.pixel_distance(v.players(spark, d), _key(spark, d), v.clips(spark, d)), "sprint_distance_m")


@query("pixel_shot", f"select clip_id, {r6('shot_distance_m')} from o_px_shot")
def _px_shot(spark, d):
    return _r6(stats.pixel_shot(_path(spark, d), v.clips(spark, d)), "shot_distance_m")


@query("metric_distance", f"select clip_id, {r6('sprint_distance_m', 'top_speed_kmh')} from o_m_run")
def _m_run(spark, d):
    return _r6(stats.metric_distance(v.players(spark, d), _key(spark, d), v.homography(spark, d), v.clips(spark, d)), "sprint_distance_m", "top_speed_kmh")


@query("metric_shot", f"select clip_id, {r6('shot_distance_m')} from o_m_shot")
def _m_shot(spark, d):
    return _r6(stats.metric_shot(_path(spark, d), v.homography(spark, d), v.clips(spark, d)), "shot_distance_m")


_STATS = ("sprint_distance_m", "top_speed_kmh", "shot_distance_m")


@query("clip_stats", f"select clip_id, metric, {r6(*_STATS)}, players_beaten from o_stats")
def _stats(spark, d):
    return _r6(stats.clip_stats(v.players(spark, d), _path(spark, d), _key(spark, d), v.clips(spark, d), v.homography(spark, d)).drop("key_track_id"), *_STATS)


# ---- top-k, union --------------------------------------------------------------------------------------
@query("top_moments", """select match_id, t, confidence, seq, kind from (select *, row_number() over (partition by match_id order by confidence desc, t, seq) as r from v_moment_rows) q where r <= 25""")
def _top(spark, d):
    return fusion.top_moments(v.moment_rows(spark, d), 25, tie=("t", "seq")).select("match_id", "t", "confidence", "seq", "kind")


@query("limit_moments", "select match_id, t, confidence, kind from (select *, row_number() over (partition by match_id order by confidence desc, t) as r from o_moments) q where r <= 5")
def _limit(spark, d):
    return fusion.limit_moments(_moments(spark, d), 5).select("match_id", "t", "confidence", "kind")


_UNION_SQL = """select match_id, t, source, strength, kind_hint, minute from (
  select match_id, t, source, round(strength, 6) as strength, kind_hint, null as minute from (
    select match_id, start_s as t, 'commentary' as source, 7e-1 as strength, 'goal' as kind_hint, {goal} as phrase from v_segments
    union all select match_id, start_s, 'commentary', 5e-1, 'chance', {chance} from v_segments
    union all select match_id, start_s, 'commentary', 5e-1, 'card', {card} from v_segments) q where phrase is not null
  union all select match_id, t, 'action_spotting', round(least(1e0, conf), 6), case label when 'Goal' then 'goal' when 'Save' then 'save' when 'Yellow card' then 'card' else 'chance' end, null
    from v_spots where conf >= 5e-1 and label <> 'Throw-in'
  union all select match_id, t, 'scoreboard_ocr', 1e0, null, minute from o_score where hit
  union all select match_id, t, 'audio', round(greatest(0e0, least(1e0, (z - 15e-1) / 25e-1)), 6), null, null from o_merged) u""".format(
    **{k: _first_word(w) for k, w in KEYWORDS.items()})


@query("all_signals", _UNION_SQL)
def _union(spark, d):
    return (_all(spark, d).select("match_id", "t", "source", F.round("strength", 6).alias("strength"), "kind_hint", "minute"))


def _all(spark, d):
    return fusion.all_signals(highlights.audio_signals(v.loudness(spark, d), AUDIO), scoreboard.score_changes(scoreboard.read_scores(v.ocr(spark, d))),
                              commentary.keyword_signals(v.segments(spark, d), KEYWORDS), commentary.spot_signals(v.spots(spark, d)))


# ---- edit plans ----------------------------------------------------------------------------------------
def _moments(spark, d):
    return highlights.detect_moments(v.signals(spark, d), v.durations(spark, d))


def _cuts(spark, d):
    return effects.cut_list(_moments(spark, d))


@query("pad_moments", """select match_id, seq, t, kind, greatest(0e0, t - case kind when 'goal' then 11e0 else 7e0 end) as start_s,
  least(duration, t + case kind when 'goal' then 7e0 else 5e0 end) as end_s from v_moment_rows join v_durations using (match_id)""")
def _pad(spark, d):
    return fusion.pad_moments(v.moment_rows(spark, d), v.durations(spark, d)).select("match_id", "seq", "t", "kind", "start_s", "end_s")


@query("cut_list", f"select match_id, clip_no, printf('clip_%02d_%s', clip_no, kind) as name, start_s, {r6('duration', 'key_t')} from o_cuts")
def _cut_list(spark, d):
    return _r6(_cuts(spark, d).select("match_id", "clip_no", "name", "start_s", "duration", "key_t"), "duration", "key_t")


_SLOW = """select reel_id, ord, duration, key_t, case when fits then s end as slow_from, case when fits then e end as slow_to, case when fits then 4e-1 end as factor from (
  select *, duration >= 4 and e - s >= 5e-1 as fits from (select *, least(s + 25e-1, duration - 4e-1) as e from (
    select *, least(greatest(4e-1, key_t - 25e-1 / 2), duration - 4e-1 - 1e-1) as s from v_timed_clips) a) b) c"""
o.step("o_slow", _SLOW)


@query("slowmo_window", f"select reel_id, ord, {r6('slow_from', 'slow_to')}, factor from o_slow")
def _slow(spark, d):
    return _r6(effects.slowmo_window(v.timed_clips(spark, d)).select("reel_id", "ord", "slow_from", "slow_to", "factor"), "slow_from", "slow_to")


@query("time_remap", f"""select reel_id, ord, mark, {r6('event_t')}, round(case when slow_from is null or event_t < slow_from then event_t when event_t < slow_to then slow_from + (event_t - slow_from) / factor
    else event_t + (slow_to - slow_from) * (1 / factor - 1) end, 6) as out_t, round(duration + coalesce((slow_to - slow_from) * (1 / factor - 1), 0), 6) as out_duration
  from v_clip_events join o_slow using (reel_id, ord)""")
def _remap(spark, d):
    windows = effects.slowmo_window(v.timed_clips(spark, d))
    return _r6(effects.time_remap(v.clip_events(spark, d), windows, by=["reel_id", "ord"]), "event_t", "out_t", "out_duration")


@query("freeze_plan", "select reel_id, ord, round(least(greatest(0e0, key_t), greatest(0e0, duration - 1e-1)), 6) as grab_t, 12e-1 as freeze_s, 36 as freeze_frames from v_timed_clips")
def _freeze(spark, d):
    return _r6(effects.freeze_plan(v.timed_clips(spark, d)).select("reel_id", "ord", "grab_t", "freeze_s", "freeze_frames"), "grab_t")


@query("telestration_geometry", """select clip_id, frame, x as spot_x, y + 30 as spot_y, 46 as spot_rx, 18 as spot_ry, x as zone_x, y as zone_y, x + 220 as zone_far_x, y - 70 as zone_top_y, y + 70 as zone_bottom_y
  from (select clip_id, frame, cast(trunc(cx) as int) as x, cast(trunc(cy) as int) as y from o_kp) q""")
def _geometry(spark, d):
    return telestration.telestration_geometry(v.players(spark, d), _key(spark, d))


@query("reel_timeline", f"select reel_id, part_no, part, ord, duration, {r6('start_s', 'end_s')} from o_timeline")
def _timeline(spark, d):
    return _r6(reel.reel_timeline(reel.select_reel(v.reel_items(spark, d))), "start_s", "end_s")


@query("clip_timeline", """select reel_id, ord, p.part_no, p.part, round(p.a, 6) as start_s, round(p.b, 6) as end_s from (select reel_id, ord, unnest([
    {part_no: 0::bigint, part: 'intro', a: 0e0, b: 1e0}, {part_no: 1::bigint, part: 'freeze', a: 1e0, b: 22e-1},
    {part_no: 2::bigint, part: 'body', a: 22e-1, b: 22e-1 + duration}, {part_no: 3::bigint, part: 'outro', a: 22e-1 + duration, b: 32e-1 + duration}]) as p from v_timed_clips) q""")
def _clip_timeline(spark, d):
    return _r6(reel.clip_timeline(v.timed_clips(spark, d), by=["reel_id", "ord"]), "start_s", "end_s")


@query("overlay_schedule", o.overlay_rows("v_overlay_in", "reel_id, ord"))
def _overlays(spark, d):
    return overlays.overlay_schedule(v.overlay_in(spark, d), by=["reel_id", "ord"])


@query("clip_caption", f"select match_id, seq, {o.CAPTION} as caption from v_moment_rows")
def _clip_caption(spark, d):
    return overlays.clip_caption(v.moment_rows(spark, d)).select("match_id", "seq", "caption")


@query("reel_caption", "select * from o_reel_caption")
def _reel_caption(spark, d):
    return overlays.reel_caption(reel.select_reel(v.reel_items(spark, d)))


# ---- models --------------------------------------------------------------------------------------------
o.step("o_f", "select cast(floor(vec_id/5e1) as bigint) as clip_id, vec_id % 50 as frame, vec_id as track_id, cast(embedding as double[]) as f from embeddings")
o.kmeans_steps("o_f", 64, "_f")


@query("team_kmeans", "select * from o_l_f")
def _kmeans(spark, d):
    rows = v.table(spark, d, "embeddings").selectExpr(
        "cast(floor(vec_id/5e1) as bigint) as clip_id", "vec_id % 50 as frame", "vec_id as track_id", "cast(embedding as array<double>) as feature")
    return teams.team_kmeans(rows).drop("feature")


def _sentences(text):
    """Sample spotter: every sentence is an event whose label and confidence follow from its length."""
    for i, part in enumerate(text.split(".")):
        if part:
            yield i * 2.0, ("Goal", "Corner", "Save")[len(part) % 3], len(part) % 100 / 100.0


@query("udtf_spotter", """select match_id, seq, t, 'action_spotting' as source, strength, kind_hint, label from (
  select match_id, seq, (k - 1) * 2e0 as t, length(w[k]) % 100 / 1e2 as strength, ['goal', 'chance', 'save'][length(w[k]) % 3 + 1] as kind_hint, ['Goal', 'Corner', 'Save'][length(w[k]) % 3 + 1] as label, w[k] as s
  from (select *, unnest(range(1, len(w) + 1)) as k from (select *, string_split(text, '.') as w from v_segments) q) r) x where s <> '' and strength >= 5e-1""")
def _spotter(spark, d):
    commentary.register_spotter(spark, "sentence_spotter", _sentences)
    found = spark.sql("select s.match_id, s.seq, f.* from {s} s, lateral sentence_spotter(s.text) f", s=v.segments(spark, d))
    return commentary.spot_signals(commentary.split_spots(found, "sentence_spotter", by=["match_id", "seq"])[0])


def _strict_sentences(text):
    """Sample spotter that cannot read texts with a sentence of 13 letters, after the sentences before it."""
    for i, part in enumerate(text.split(".")):
        if len(part) == 13:
            raise ValueError(f"cannot read sentence {i}")
        if part:
            yield i * 2.0, "Goal", len(part) % 100 / 100.0


_STRICT = """(select *, (select min(k) from unnest(range(0, len(w))) u(k) where length(w[k + 1]) = 13) as stop
  from (select match_id, seq, string_split(text, '.') as w from v_segments) q) q"""


@query("spotter_rest", f"""select match_id, seq, t, 'action_spotting' as source, strength, 'goal' as kind_hint, 'Goal' as label from (
  select match_id, seq, k * 2e0 as t, length(w[k + 1]) % 100 / 1e2 as strength, w[k + 1] as s from (select *, unnest(range(0, coalesce(stop, len(w)))) as k from {_STRICT}) x) y
  where s <> '' and strength >= 5e-1""")
def _spotter_rest(spark, d):
    return commentary.spot_signals(_strict_spots(spark, d)[0])


@query("spotter_errors", f"""select match_id, 'strict_spotter' as detector, count(*) as n_failed, min(concat('ValueError: cannot read sentence ', stop)) as error
  from {_STRICT} where stop is not null group by match_id""")
def _spotter_errors(spark, d):
    return _strict_spots(spark, d)[1]


def _strict_spots(spark, d):
    commentary.register_spotter(spark, "strict_spotter", _strict_sentences)
    found = spark.sql("select s.match_id, s.seq, f.* from {s} s, lateral strict_spotter(s.text) f", s=v.segments(spark, d))
    return commentary.split_spots(found, "strict_spotter")


class _Echo:
    """Sample spotter over a whole match: two segments in a row whose lengths fall into the same class, and the longest one at the end."""

    def __init__(self, settings):
        self.classes, self.last, self.longest = settings["classes"], None, (0, 0.0)

    def see(self, row):
        n = len(row["text"] or "")
        if self.last is not None and n % self.classes == self.last % self.classes:
            yield row["start_s"], "Goal", n % 100 / 100
        self.last, self.longest = n, max(self.longest, (n, row["start_s"]))

    def end(self):
        yield self.longest[1], "Save", 1.0


@query("match_spotter", """select match_id, t, 'action_spotting' as source, strength, kind_hint, label from (
  select match_id, start_s as t, n % 100 / 1e2 as strength, 'goal' as kind_hint, 'Goal' as label
    from (select *, length(text) as n, lag(length(text)) over (partition by match_id order by seq) as p from v_segments) q where n % 3 = p % 3
  union all select match_id, max({n: length(text), t: start_s}).t, 1e0, 'save', 'Save' from v_segments group by match_id) q where strength >= 5e-1""")
def _match_spotter(spark, d):
    commentary.register_match_spotter(spark, "echo_spotter", _Echo)
    found = spark.sql("""select * from echo_spotter(table({s}), '{{"classes": 3}}')""", s=v.segments(spark, d))
    return commentary.spot_signals(commentary.split_spots(found, "echo_spotter")[0])


@query("clip_errors", """select match_id, count(*) as n_rows, count(*) filter (where try_cast(raw as double) is null) as n_failed,
    min(raw) filter (where try_cast(raw as double) is null) as first_error, 'probe' as detector,
    case when count(*) filter (where try_cast(raw as double) is null) = count(*) then 'failed' when count(*) filter (where try_cast(raw as double) is null) > 0 then 'partial' else 'ok' end as status
  from v_raw_values group by match_id""")
def _errors(spark, d):
    return commentary.isolate_failures(v.raw_values(spark, d), F.col("raw").try_cast("double"), raw="raw", detector="probe")[1]


# ---- end to end ----------------------------------------------------------------------------------------
@query("detect_moments", "select match_id, t, start_s, end_s, confidence, kind, minute, sources, signal_count from o_moments")
def _detect(spark, d):
    return _moments(spark, d).withColumn("sources", F.array_join("sources", ","))


@query("audio_signals", "select match_id, t, 'audio' as source, round(greatest(0e0, least(1e0, (z - 15e-1) / 25e-1)), 6) as strength, round(z, 6) as zscore from o_merged")
def _audio(spark, d):
    return _r6(highlights.audio_signals(v.loudness(spark, d), AUDIO), "strength", "zscore")


# small chunks: the results must not depend on where chunks end
@query("audio_signals_chunked", ORACLES["audio_signals"])
def _audio_chunked(spark, d):
    return _r6(highlights.audio_signals(v.loudness(spark, d), AUDIO, chunk=64, chunk_seconds=40.0), "strength", "zscore")


@query("score_changes_chunked", ORACLES["score_changes"])
def _changes_chunked(spark, d):
    return scoreboard.score_changes(scoreboard.read_scores(v.ocr(spark, d)), chunk_seconds=60.0, chunk=3)


@query("camera_path_chunked", ORACLES["camera_path"])
def _camera_chunked(spark, d):
    return _r6(reframe.camera_path(v.frames(spark, d), v.players(spark, d), tracking.interpolate_ball(v.ball(spark, d), chunk=8), v.clips(spark, d), chunk=8), "cx")


@query("scoreboard_signals", o.CHANGES.format(fold="o_sampled_score"))
def _board(spark, d):
    frames = v.ocr(spark, d).withColumn("idx", F.floor(F.col("t") * 25).cast("long")).withColumn("fps", F.lit(25.0)).drop("t")
    return highlights.scoreboard_signals(frames, every_s=0.2)


def _analytics(spark, d):
    return highlights.clip_analytics(v.players(spark, d), _dets(spark, d), v.clips(spark, d), homography=v.homography(spark, d),
                                     classes=_det_classes(spark, d), features=v.features(spark, d))


@query("clip_analytics", f"select clip_id, metric, {r6(*_STATS)}, players_beaten, key_track_id from o_stats_b")
def _analytics_query(spark, d):
    return _r6(_analytics(spark, d), *_STATS)


@query("reel_plan", f"select match_id, part_no, part, ord, {r6('duration', 'start_s', 'end_s')}, n_moments, n_goals, caption from o_timeline_m join o_reel_caption_m using (match_id)")
def _reel_plan(spark, d):
    return _r6(highlights.reel_plan(_with_status(_moments(spark, d))), "duration", "start_s", "end_s")


@query("overlay_plan", o.overlay_rows("o_plan_in", "match_id, clip_no, clip_id, caption"))
def _overlay_plan(spark, d):
    # the clips of the table take turns, however many they are
    cuts = spark.sql("select *, (match_id + clip_no) % (select count(*) from {clips}) as clip_id from {cuts}", cuts=_cuts(spark, d), clips=v.clips(spark, d))
    return highlights.overlay_plan(cuts, _analytics(spark, d))


# ---- live: a stream over the whole table and the ends of its matches ------------------------------------
_DAY = 86_400_000  # matches start a day after the epoch: Spark takes a row at the epoch itself for late


def _timed(df):
    return df.withColumn("ts", F.timestamp_micros(_DAY * 1000 + F.round(F.col("t") * 1e6).cast("long")))


@query("live_moments", "select l.match_id, l.t, r.confidence, l.kind, l.minute, l.signal_count from o_labelled l join o_rounded r using (match_id, cluster)")
def _live_moments(spark, d):
    rows = _timed(v.signals_of(spark, replay.stream_table(spark, f"{d}/events.parquet")))
    ends = replay.match_ends(_timed(v.signals_of(spark, v.table(spark, d, "events"))))
    return replay.run_available(live.live_moments(rows, ends=ends)).drop("opened")


@query("live_keywords", ORACLES["keyword_signals"])
def _live_keywords(spark, d):
    rows = replay.stream_table(spark, f"{d}/conversations.parquet").selectExpr(
        "conv_id as match_id", "turn as seq", "turn*15e0 as start_s", "text")
    return replay.run_available(commentary.keyword_signals(rows, KEYWORDS))


# texts of a live board cannot carry running totals, so the score comes from the event itself
_LIVE_BOARD = "cast(event_id % 3 as int) as home, cast(event_id % 2 as int) as away, cast(event_id % 90 as int) as minute"
o.step("o_live_read", f"select user_id as match_id, event_id as seq, {v.US_SQL}/864e6 as t, {_LIVE_BOARD} from events")
o.score_fold("o_live_read", "o_live_line", "o_live_score")


@query("live_score_changes", "select match_id, t, seq, concat(h, '-', a) as score, concat(ph, '-', pa) as prev, minute from o_live_score where hit")
def _live_scores(spark, d):
    read = lambda e: _timed(spark.sql(f"select user_id as match_id, event_id as seq, {v.US}/864e6 as t, {_LIVE_BOARD} from {{e}}", e=e))
    ends = replay.match_ends(read(v.table(spark, d, "events")))
    return replay.run_available(live.live_score_changes(read(replay.stream_table(spark, f"{d}/events.parquet")), ends=ends))


@query("live_loudness", """select match_id, round(w * 5e-1, 6) as from_s, round(sqrt(sum(x * x) / 4e0), 6) as rms from (
    select match_id, x, unnest([idx // 2 - 1, idx // 2]) as w from v_samples) q group by match_id, w""")
def _live_loudness(spark, d):
    # four samples per second of match time
    read = lambda o: o.selectExpr("cast(floor(o_orderkey/1e3) as bigint) as match_id", f"timestamp_millis({_DAY} + (o_orderkey % 1000) * 250) as ts", "o_totalprice/5e5 - 5e-1 as x")
    ends = replay.match_ends(read(v.table(spark, d, "orders")))
    out = replay.run_available(live.live_loudness(read(replay.stream_table(spark, f"{d}/orders.parquet")), rate=4.0, ends=ends))
    return out.select("match_id", ((F.unix_millis("from_ts") - _DAY) / 1000.0).alias("from_s"), F.round("rms", 6).alias("rms"))
