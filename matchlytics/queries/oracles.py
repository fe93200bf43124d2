"""Check SQL: each result written the plain way, one step per named query.

`sql(body)` puts the views and steps that a body names in front of it.
"""

from __future__ import annotations

import re

from .views import SQL as VIEW_SQL

STEPS: dict[str, str] = dict(VIEW_SQL)


def step(name: str, body: str) -> None:
    STEPS[name] = body


def _needs(body: str, done: dict) -> None:
    for name in re.findall(r"\b[vo]_\w+", body):
        if name in STEPS and name not in done:
            done[name] = None  # a step may name itself (recursion)
            _needs(STEPS[name], done)
            del done[name]
            done[name] = STEPS[name]


def sql(body: str) -> str:
    done: dict = {}
    _needs(body, done)
    head = ",\n".join(f"{n} as ({b})" for n, b in done.items())
    return f"with recursive {head}\n{body}" if head else body


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c.split('.')[-1]}" for c in cols)


# ---- moments -------------------------------------------------------------------------------------------
step("o_line", """select *, row_number() over (partition by match_id order by t, seq) as rn,
  case when t - lag(t) over (partition by match_id order by t, seq) <= 8e0 then 0 else 1 end as fresh from v_signals""")
step("o_clustered", """select *, cast(sum(fresh) over (partition by match_id order by rn) - 1 as bigint) as cluster from o_line""")
step("o_sources", """select match_id, cluster, source, max(strength) as s, min(rn) as rn0 from o_clustered group by all""")
step("o_scores", """select match_id, cluster, string_agg(source, ',' order by source) as sources,
  least(1e0, sum(s * case source when 'action_spotting' then 12e-1 when 'scoreboard_ocr' then 1e0 when 'audio' then 6e-1
    when 'commentary' then 5e-1 when 'scene_replay' then 4e-1 else 0e0 end order by rn0)) as conf from o_sources group by all""")
step("o_facts", """select match_id, cluster, count(*) as signal_count, min(rn) as rn0, first(t order by rn) as first_t,
  first(t order by rn) filter (where source = 'scoreboard_ocr') as board_t,
  first(t order by strength desc, rn) filter (where source = 'audio') as audio_t,
  first(minute order by rn) filter (where minute is not null) as minute,
  coalesce(bool_or(source = 'action_spotting' and kind_hint = 'goal'), false) as sg, coalesce(bool_or(source = 'action_spotting' and kind_hint = 'card'), false) as sc,
  coalesce(bool_or(source = 'action_spotting' and kind_hint = 'save'), false) as ss, coalesce(bool_or(source = 'action_spotting' and kind_hint = 'chance'), false) as sh,
  coalesce(bool_or(source = 'commentary' and kind_hint = 'goal'), false) as cg, coalesce(bool_or(source = 'commentary' and kind_hint = 'card'), false) as cc,
  coalesce(bool_or(source = 'commentary' and kind_hint = 'chance'), false) as ch, coalesce(bool_or(contains(phrase, 'saved')), false) as saved
  from o_clustered group by all""")
step("o_labelled", """select f.*, s.conf, s.sources,
  case when sg then 'goal' when sc then 'card' when ss then 'save' when sh then 'chance' when board_t is not null then 'goal'
       when cg then 'goal' when cc then 'card' when ch and saved then 'save' else 'chance' end as kind,
  coalesce(case when board_t is not null then greatest(0e0, board_t - 6e0) end, audio_t, first_t) as t
  from o_facts f join o_scores s using (match_id, cluster)""")
# rounding by the exact binary value, ties to even: whole-number arithmetic at 2^62
step("o_scaled", """select *, cast(conf * 4611686018427387904 as hugeint) * 1000 // 4611686018427387904 as low, cast(conf * 4611686018427387904 as hugeint) * 1000 % 4611686018427387904 as rest
  from o_labelled where conf >= 45e-2""")
step("o_rounded", """select * exclude (low, rest), cast(low + case when rest > 2305843009213693952 or (rest = 2305843009213693952 and low % 2 = 1) then 1 else 0 end as double) / 1e3 as confidence from o_scaled""")
step("o_ranked", "select *, row_number() over (partition by match_id order by confidence desc, rn0) as place from o_rounded")
step("o_moments", """select match_id, t, greatest(0e0, t - case kind when 'goal' then 11e0 else 7e0 end) as start_s,
  least(duration, t + case kind when 'goal' then 7e0 else 5e0 end) as end_s, confidence, kind, minute, sources, signal_count
  from o_ranked join v_durations using (match_id) where place <= 25""")
step("o_cuts", """select *, row_number() over (partition by match_id order by t, start_s) - 1 as clip_no,
  greatest(5e-1, end_s - start_s) as duration, greatest(0e0, t - start_s) as key_t from o_moments""")

# ---- audio ---------------------------------------------------------------------------------------------
step("o_raw_db", "select *, 20 * log10(greatest(1e-5, rms + 1e-9)) as raw from v_loudness")
step("o_db", "select match_id, idx, t, rms, greatest(raw, max(raw) over (partition by match_id) - 80) as db from o_raw_db")
step("o_smooth", "select *, sum(db) over (partition by match_id order by idx rows between 3 preceding and 2 following) / 6 as smooth from o_db")
step("o_z", """select *, (smooth - quantile_cont(smooth, 0.5) over w) / (stddev_pop(smooth) over w + 1e-6) as z from o_smooth
  window w as (partition by match_id order by idx rows between 30 preceding and 30 following)""")
step("o_runs", "select *, idx - row_number() over (partition by match_id order by idx) as run from o_z where z > 15e-1")
step("o_peaks", """select match_id, first(idx order by z desc, idx) as idx, first(t order by z desc, idx) as t, max(z) as z, count(*) as n
  from o_runs group by match_id, run""")
step("o_peak_line", "select *, row_number() over (partition by match_id order by t) as rn from o_peaks")
step("o_merge", """select match_id, rn, t as kt, z as kz, false as closes, cast(null as double) as pt, cast(null as double) as pz from o_peak_line where rn = 1
  union all
  select p.match_id, p.rn, case when p.t - m.kt >= {gap} or p.z > m.kz then p.t else m.kt end, case when p.t - m.kt >= {gap} or p.z > m.kz then p.z else m.kz end,
    p.t - m.kt >= {gap}, m.kt, m.kz
  from o_merge m join o_peak_line p on p.match_id = m.match_id and p.rn = m.rn + 1""".format(gap="25e0"))
step("o_merged", """select match_id, pt as t, pz as z from o_merge where closes
  union all select match_id, last(kt order by rn) as t, last(kz order by rn) as z from o_merge group by match_id""")
step("o_len", "select match_id, max(idx) + 1 as n from v_samples group by match_id")
step("o_hops", "select match_id, n, unnest(range(cast(floor((n + 2 * 10 - 20) / 8) as bigint) + 1)) as hop_no from o_len")

# ---- scoreboard ----------------------------------------------------------------------------------------
_SCORE, _MINUTE = r"\b([0-9]{1,2})\s*[-:vV]\s*([0-9]{1,2})\b", r"\b([0-9]{1,3})\s*[′'']?\b"
PARSED = f"""cast(nullif(regexp_extract(text, '{_SCORE}', 1), '') as int) as home, cast(nullif(regexp_extract(text, '{_SCORE}', 2), '') as int) as away,
  case when cast(nullif(regexp_extract(text, '{_MINUTE}', 1), '') as int) <= 130 then cast(nullif(regexp_extract(text, '{_MINUTE}', 1), '') as int) end as minute"""


def score_fold(reads: str, line: str, fold: str) -> None:
    step(line, f"select *, row_number() over (partition by match_id order by t, seq) as rn from {reads} where home is not null")
    up = "((p.home - f.h = 1 and p.away = f.a) or (p.home = f.h and p.away - f.a = 1))"
    step(fold, f"""select match_id, rn, t, seq, home as h, away as a, home as ph, away as pa, minute, false as hit from {line} where rn = 1
      union all
      select p.match_id, p.rn, p.t, p.seq, case when {up} then p.home else f.h end, case when {up} then p.away else f.a end, f.h, f.a, p.minute, {up}
      from {fold} f join {line} p on p.match_id = f.match_id and p.rn = f.rn + 1""")


step("o_read", f"select match_id, seq, t, text, {PARSED} from v_ocr")
score_fold("o_read", "o_read_line", "o_score")
step("o_sampled", f"select match_id, seq, cast(floor(t * 25) as bigint) / 25e0 as t, {PARSED} from v_ocr where cast(floor(t * 25) as bigint) % 5 = 0")
score_fold("o_sampled", "o_sampled_line", "o_sampled_score")
CHANGES = """select match_id, t, seq, 'scoreboard_ocr' as source, 1e0 as strength, concat(h, '-', a) as score, concat(ph, '-', pa) as prev, minute from {fold} where hit"""

# ---- tracking ------------------------------------------------------------------------------------------
step("o_best_ball", """select clip_id, frame, first((x1 + x2) / 2 order by case model when 'ball' then 1 else 0 end desc, conf desc, det_ord) as ball_x,
  first((y1 + y2) / 2 order by case model when 'ball' then 1 else 0 end desc, conf desc, det_ord) as ball_y,
  first(conf order by case model when 'ball' then 1 else 0 end desc, conf desc, det_ord) as conf,
  first(model order by case model when 'ball' then 1 else 0 end desc, conf desc, det_ord) as model
  from v_dets where model = 'ball' or class_id = 1 + clip_id % 5 % 2 group by clip_id, frame""")


def kmeans_steps(src: str, dim: int, tag: str) -> None:
    """Step o_l<tag>: labels of two-centre k-means of `src` (clip_id, frame, track_id, f), five starts run until no label moves."""
    chance = "((cast('0x' || substr(md5(concat_ws(':', s, {j}, frame, track_id)), 1, 8) as bigint) + 5e-1) / 4294967296e0)"
    near = "case when list_distance(f, {b}) < list_distance(f, {a}) then 1 else 0 end"
    step(f"o_s{tag}", f"""select clip_id, s, first(f order by {chance.format(j=0)}, frame, track_id) as a from {src}, range(5) r(s)
      where clip_id in (select clip_id from {src} group by clip_id having count(*) >= 6) group by clip_id, s""")
    step(f"o_i{tag}", f"""select clip_id, s, any_value(a) as a,
      coalesce(first(f order by ln({chance.format(j=1)}) / pow(list_distance(f, a), 2) desc) filter (list_distance(f, a) > 0), any_value(a)) as b
      from {src} join o_s{tag} using (clip_id) group by clip_id, s""")
    step(f"o_r{tag}", f"""select clip_id, s, 0 as i, a, b, cast(null as double[]) as pa, cast(null as double[]) as pb from o_i{tag}
      union all
      select clip_id, s, i + 1, list(coalesce(ma, a[d + 1]) order by d), list(coalesce(mb, b[d + 1]) order by d), a, b from (
        select clip_id, s, i, a, b, d, avg(x) filter (label = 0) as ma, avg(x) filter (label = 1) as mb, count(*) filter (label <> before) as moved from (
          select *, unnest(f) as x, unnest(range({dim})) as d from (
            select r.*, f, {near.format(a="a", b="b")} as label, case when pa is null then -1 else {near.format(a="pa", b="pb")} end as before
            from o_r{tag} r join {src} using (clip_id)) q) q group by clip_id, s, i, a, b, d) q
      group by clip_id, s, i, a, b having sum(moved) > 0""")
    step(f"o_e{tag}", f"""select clip_id, s, a, b, sum(least(pow(list_distance(f, a), 2), pow(list_distance(f, b), 2))) as spread
      from (select * from o_r{tag} qualify row_number() over (partition by clip_id, s order by i desc) = 1) q join {src} using (clip_id) group by all""")
    step(f"o_k{tag}", f"""select clip_id, first(a order by s) as a, first(b order by s) as b from (select *, min(spread) over (partition by clip_id) as least from o_e{tag}) q
      where spread <= (1 + 1e-9) * least group by clip_id""")
    step(f"o_l{tag}", f"""select clip_id, frame, track_id, cast(label <> first_value(label) over (partition by clip_id order by frame, track_id) as integer) as label
      from (select clip_id, frame, track_id, {near.format(a="a", b="b")} as label from {src} join o_k{tag} using (clip_id)) q""")


def _ball_steps(src: str, tag: str, team: str = "v_track_team") -> None:
    """Steps o_path<tag>, o_holders<tag>, o_votes<tag>, o_key<tag>, o_poss<tag>, stats ... of one ball table."""
    step(f"o_next{tag}", f"""select *, lead(frame) over w - frame as gap, lead(ball_x) over w as nx, lead(ball_y) over w as ny from {src}
      window w as (partition by clip_id order by frame)""")
    step(f"o_path{tag}", f"""select clip_id, frame, ball_x, ball_y, false as filled from o_next{tag}
      union all select clip_id, frame + k, ball_x + k / gap * (nx - ball_x), ball_y + k / gap * (ny - ball_y), true
      from (select *, unnest(range(1, gap)) as k from o_next{tag} where gap between 2 and 8) q""")
    step(f"o_near{tag}", f"""select p.clip_id, p.frame, p.track_id,
      row_number() over (partition by p.clip_id, p.frame order by (cx - ball_x) * (cx - ball_x) + (cy - ball_y) * (cy - ball_y), det_ord) as place
      from v_players p join {src} b using (clip_id, frame) join v_clips c using (clip_id) where p.frame >= cast(floor(c.n_frames * 6e-1) as bigint)""")
    step(f"o_votes{tag}", f"select clip_id, track_id, count(*) as votes, min(frame) as since from o_near{tag} where place = 1 group by all")
    step(f"o_key{tag}", f"select clip_id, first(track_id order by votes desc, since) as key_track_id, max(votes) as votes from o_votes{tag} group by clip_id")
    step(f"o_attack{tag}", f"""select clip_id, first(team order by n desc, since) as attacking_team from (
      select clip_id, team, sum(votes) as n, min(since) as since from o_votes{tag} join {team} using (clip_id, track_id) group by all) q group by clip_id""")
    step(f"o_poss{tag}", f"""select k.clip_id, coalesce((select first(v.track_id order by v.votes desc, v.since) from o_votes{tag} v join {team} t using (clip_id, track_id)
        where v.clip_id = k.clip_id and t.team = a.attacking_team), k.key_track_id) as key_track_id, a.attacking_team
      from o_key{tag} k left join o_attack{tag} a using (clip_id)""")


def _stat_steps(key: str, path: str, tag: str, maps: str = "v_homography", coverage: str = "o_coverage") -> None:
    step(f"o_kp{tag}", f"select p.* from v_players p join {key} k on k.clip_id = p.clip_id and k.key_track_id = p.track_id")
    step(f"o_kd{tag}", f"select *, cx - lag(cx) over w as dx, cy - lag(cy) over w as dy from o_kp{tag} window w as (partition by clip_id order by frame, det_ord)")
    step(f"o_px_run{tag}", f"""select k.clip_id, coalesce(sum(sqrt(dx * dx + dy * dy)), 0e0) / (1920 / 6e1) as sprint_distance_m
      from {key} k left join o_kd{tag} using (clip_id) group by k.clip_id""")
    step(f"o_tail{tag}", f"""select b.*, c.fps, row_number() over (partition by clip_id order by frame desc) as back from {path} b join v_clips c using (clip_id)""")
    step(f"o_px_tail{tag}", f"select *, ball_x - lag(ball_x) over w as dx, ball_y - lag(ball_y) over w as dy from o_tail{tag} where back <= cast(floor(fps / 2) as int) window w as (partition by clip_id order by frame)")
    step(f"o_px_shot{tag}", f"select clip_id, coalesce(sum(sqrt(dx * dx + dy * dy)), 0e0) / (1920 / 6e1) as shot_distance_m from o_px_tail{tag} group by clip_id")
    proj = """(h[1] * {x} + h[2] * {y} + h[3]) / (h[7] * {x} + h[8] * {y} + h[9]) as px, (h[4] * {x} + h[5] * {y} + h[6]) / (h[7] * {x} + h[8] * {y} + h[9]) as py"""
    for name, src, x, y in ((f"o_mr{tag}", f"o_kp{tag}", "cx", "cy"), (f"o_ms{tag}", f"o_tail{tag}", "ball_x", "ball_y")):
        where = " and back <= greatest(2, cast(floor(fps / 2) as int))" if x == "ball_x" else ""
        step(f"{name}p", f"select s.clip_id, s.frame, {proj.format(x=x, y=y)} from {src} s join {maps} m using (clip_id, frame) where h is not null and abs(h[7] * {x} + h[8] * {y} + h[9]) >= 1e-9{where}")
        step(f"{name}d", f"""select *, sqrt((px - lag(px) over w) * (px - lag(px) over w) + (py - lag(py) over w) * (py - lag(py) over w)) as d,
          greatest(1, frame - lag(frame) over w) / 4e0 as dt from {name}p window w as (partition by clip_id order by frame)""")
        step(f"{name}s", f"""select clip_id, coalesce(sum(d) filter (where d <= 12), 0e0) as distance_m,
          coalesce(max(d / dt * 36e-1) filter (where d <= 12 and d / dt * 36e-1 < 45), 0e0) as top_speed_kmh from {name}d group by clip_id""")
    step(f"o_m_run{tag}", f"""select k.clip_id, coalesce(distance_m, 0e0) as sprint_distance_m, coalesce(top_speed_kmh, 0e0) as top_speed_kmh
      from {key} k left join o_mr{tag}s using (clip_id)""")
    step(f"o_m_shot{tag}", f"select clip_id, nullif(distance_m, 0e0) as shot_distance_m from o_ms{tag}s")
    step(f"o_rel{tag}", f"""select p.clip_id, p.track_id, p.frame, p.cx - k.cx as rel, lag(p.cx - k.cx) over (partition by p.clip_id, p.track_id order by p.frame, p.det_ord) as was
      from v_players p join o_kp{tag} k on k.clip_id = p.clip_id and k.frame = p.frame and k.track_id <> p.track_id""")
    step(f"o_beaten{tag}", f"""select k.clip_id, least(6, count(distinct r.track_id)) as players_beaten
      from {key} k left join o_rel{tag} r on r.clip_id = k.clip_id and r.was < 0 and r.rel >= 0 group by k.clip_id""")
    step(f"o_stats{tag}", f"""select c.clip_id, coalesce(v.coverage > 5e-1, false) as metric,
      case when coalesce(v.coverage > 5e-1, false) then mr.sprint_distance_m else pr.sprint_distance_m end as sprint_distance_m,
      case when coalesce(v.coverage > 5e-1, false) then mr.top_speed_kmh end as top_speed_kmh,
      case when coalesce(v.coverage > 5e-1, false) then ms.shot_distance_m else ps.shot_distance_m end as shot_distance_m,
      coalesce(b.players_beaten, 0) as players_beaten, k.key_track_id
      from v_clips c left join {coverage} v using (clip_id) left join o_px_run{tag} pr using (clip_id) left join o_px_shot{tag} ps using (clip_id)
      left join o_m_run{tag} mr using (clip_id) left join o_m_shot{tag} ms using (clip_id) left join o_beaten{tag} b using (clip_id) left join {key} k using (clip_id)""")


step("o_coverage", "select clip_id, avg(case when h is not null then 1e0 else 0e0 end) as coverage, count(*) as n_frames from v_homography group by clip_id")
_ball_steps("v_ball", "")
_stat_steps("o_key", "o_path", "")
step("o_coverage_b", "select clip_id, avg(case when h is not null then 1e0 else 0e0 end) as coverage from o_hema group by clip_id")
kmeans_steps("v_features", 3, "_t")
step("o_team_b", """select clip_id, track_id, first(label order by n desc, since) as team from (
  select clip_id, track_id, label, count(*) as n, min(frame) as since from o_l_t group by all) q group by all""")
_ball_steps("o_best_ball", "_b", "o_team_b")
_stat_steps("o_poss_b", "o_path_b", "_b", "o_hema", "o_coverage_b")

step("o_focus", """select f.clip_id, f.frame, coalesce(b.ball_x, p.mx) as x, row_number() over (partition by f.clip_id order by f.frame) as rn
  from v_frames f left join o_path b using (clip_id, frame) left join (select clip_id, frame, avg(cx) as mx from v_players group by all) p using (clip_id, frame)""")
step("o_cam", """select clip_id, frame, rn, coalesce(x, 960e0) as focus, coalesce(x, 960e0) as cx from o_focus where rn = 1
  union all
  select f.clip_id, f.frame, f.rn, coalesce(f.x, c.focus), 85e-2 * c.cx + (1 - 85e-2) * coalesce(f.x, c.focus)
  from o_cam c join o_focus f on f.clip_id = c.clip_id and f.rn = c.rn + 1""")
step("o_hline", "select *, row_number() over (partition by clip_id order by frame) as rn from v_homography")
step("o_hema", """select clip_id, frame, rn, h from o_hline where rn = 1
  union all
  select l.clip_id, l.frame, l.rn, case when l.h is null then e.h when e.h is null then l.h
    else list_transform(range(1, 10), lambda i: 8e-1 * e.h[i] + (1 - 8e-1) * l.h[i]) end
  from o_hema e join o_hline l on l.clip_id = e.clip_id and l.rn = e.rn + 1""")
step("o_motion", """select f.clip_id, f.frame, list({x: p.cx, y: p.cy} order by p.frame) as pts, count(*) as n
  from v_frames f join o_kp p on p.clip_id = f.clip_id and p.frame between f.frame - 30 and f.frame group by all having count(*) >= 5""")

# ---- reels ---------------------------------------------------------------------------------------------


def _reel_steps(items: str, key: str, tag: str) -> None:
    step(f"o_items{tag}", f"select *, row_number() over (partition by {key} order by confidence desc, ord) as rn from {items}")
    skip = "(r.done or (r.total + i.duration > 60 and r.n > 0))"
    step(f"o_pick{tag}", f"""select {key}, rn, ord, duration as total, 1 as n, duration >= 45 as done, true as taken from o_items{tag} where rn = 1
      union all
      select i.{key}, i.rn, i.ord, case when {skip} then r.total else r.total + i.duration end, case when {skip} then r.n else r.n + 1 end,
        r.done or (not {skip} and r.total + i.duration >= 45), not {skip}
      from o_pick{tag} r join o_items{tag} i on i.{key} = r.{key} and i.rn = r.rn + 1""")
    step(f"o_chosen{tag}", f"""select i.*, row_number() over (partition by i.{key} order by i.ord) - 1 as slot
      from o_items{tag} i join o_pick{tag} p using ({key}, ord) where p.taken""")
    step(f"o_parts{tag}", f"""select {key}, 1 as r, slot, 'segment' as part, ord, duration from o_chosen{tag}
      union all select distinct {key}, 0, 0, 'intro', null, 1e0 from o_chosen{tag} union all select distinct {key}, 2, 0, 'outro', null, 1e0 from o_chosen{tag}""")
    step(f"o_timeline{tag}", f"""select {key}, row_number() over w - 1 as part_no, part, ord, duration, sum(duration) over w - duration as start_s, sum(duration) over w as end_s
      from o_parts{tag} window w as (partition by {key} order by r, slot rows unbounded preceding)""")
    step(f"o_reel_caption{tag}", f"""select {key}, count(*) as n_moments, count(*) filter (where kind = 'goal') as n_goals,
      concat(upper(concat(case when count(*) filter (where kind = 'goal') > 0 then concat(count(*) filter (where kind = 'goal'), ' goals') else concat(count(*), ' moments') end, ' in 60s')),
        ' breakdown — Spot the defender''s mistake 👀', chr(10), chr(10), '#football #soccer #goal #highlights #tactics') as caption from o_chosen{tag} group by {key}""")


_reel_steps("v_reel_items", "reel_id", "")
# every clip of a moment in the first of five seconds has failed
step("o_cut_status", "select *, case when cast(floor(t) as bigint) % 5 = 0 then 'failed' else 'ok' end as status from o_cuts")
step("o_cut_slow", """select *, least(s + 25e-1, duration - 4e-1) as e from (
  select *, least(greatest(4e-1, key_t - 25e-1 / 2), duration - 4e-1 - 1e-1) as s from o_cut_status where status = 'ok') q""")
step("o_cut_items", """select * replace (duration + case when duration >= 4 and e - s >= 5e-1 then (e - s) * 15e-1 else 0e0 end + 12e-1 as duration), clip_no as ord from o_cut_slow""")
_reel_steps("o_cut_items", "match_id", "_m")

# ---- captions and overlays -----------------------------------------------------------------------------
step("o_word_line", "select *, row_number() over (partition by clip_id order by turn, pos) - 1 as no from v_words")
step("o_lines", r"""select clip_id, cast(floor(no / 4) as bigint) as line_no, regexp_replace(string_agg(' ' || word, '' order by no), '^\s+|\s+$', '', 'g') as text,
  first(start_s order by no) as start_s, last(end_s order by no) as end_s from o_word_line group by clip_id, cast(floor(no / 4) as bigint)""")
HOOKS = """case kind when 'chance' then ['How did this NOT go in?? 😱', 'Best save of the season?'] when 'skill' then ['Watch the run, not the ball 🎯']
  else ['Spot the defender''s mistake 👀', 'Rate this finish 1-10 🔥', 'Guess who scored 👇'] end"""
CAPTION = """concat(upper(kind), ' breakdown — ', case kind when 'goal' then 'Spot the defender''s mistake 👀' when 'chance' then 'How did this NOT go in?? 😱'
  when 'skill' then 'Watch the run, not the ball 🎯' else '' end, chr(10), chr(10), '#football #soccer #goal #highlights #tactics')"""


def overlay_rows(src: str, keys: str) -> str:
    """Select of all overlay texts of `src`, numbered in drawing order."""
    stat = lambda no, text, cond: f"select {keys}, {no} as grp, {text} as text, null as t0, null as t1, 'stat' as style from {src} where metric is not null and {cond}"
    approx = "case when metric then '' else '~' end"
    num = lambda c: f"cast(cast(round_even({c}, 0) as bigint) as string)"
    parts = [
        f"select {keys}, 0 as grp, hook as text, 0e0 as t0, 16e-1 as t1, 'hook' as style from {src} where hook <> ''",
        f"select {keys}, 1, concat(upper(kind), case when minute is not null then concat('  -  ', minute, '''') else '' end), null, null, 'lower_third' from {src}",
        stat(2, f"concat('Shot: ', {approx}, {num('shot_distance_m')}, ' m')", "shot_distance_m <> 0"),
        stat(3, f"concat('Sprint: ', {approx}, {num('sprint_distance_m')}, ' m')", "sprint_distance_m <> 0"),
        stat(4, f"concat('Top speed: ', {num('top_speed_kmh')}, ' km/h')", "top_speed_kmh <> 0"),
        stat(5, "concat('Beaten: ', players_beaten)", "players_beaten is not null"),
        f"select {keys}, 6, '@yourchannel', null, null, 'watermark' from {src}"]
    return f"""select {keys}, row_number() over (partition by {keys} order by grp) - 1 as overlay_no, text, t0, t1, style,
      case when style = 'stat' then cast(70 * (row_number() over (partition by {keys}, style order by grp) - 1) as int) else 0 end as y_offset
      from ({' union all '.join(parts)}) q"""


step("o_plan_in", f"""select c.*, (match_id + clip_no) % (select count(*) from v_clips) as clip_id, s.metric, s.sprint_distance_m, s.top_speed_kmh, s.shot_distance_m, s.players_beaten,
  list_extract({HOOKS}, cast((row_number() over (partition by match_id, kind order by t, clip_no) - 1) % len({HOOKS}) as int) + 1) as hook,
  {CAPTION} as caption from o_cuts c left join o_stats_b s on s.clip_id = (match_id + clip_no) % (select count(*) from v_clips)""")
