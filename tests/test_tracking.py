import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlytics.operators import pitch, reframe, stats, teams, telestration, tracking

PLAYERS = "clip_id long, frame long, track_id long, det_ord long, cx double, cy double"
BALL = "clip_id long, frame long, ball_x double, ball_y double"
CLIPS = "clip_id long, width int, height int, fps double, n_frames int"


def clips(spark, n=10, fps=4.0):
    return spark.createDataFrame([(1, 1920, 1080, fps, n)], CLIPS)


@pytest.mark.parametrize("chunk", [8, 1000])
def test_gap_fill(spark, chunk):
    frames = [0, 1, 3, 11, 20, 21, 29]
    ball = spark.createDataFrame([(1, f, float(f * 10), float(f)) for f in frames], BALL)
    got = {r.frame: (r.ball_x, r.filled) for r in tracking.interpolate_ball(ball, chunk=chunk).collect()}
    missing = set(range(12, 20))  # a gap of 9 stays open, one of 8 is filled
    assert set(got) == set(range(30)) - missing
    assert all(got[f][0] == pytest.approx(f * 10) and got[f][1] == (f not in frames) for f in got)


def test_best_ball(spark):
    df = spark.createDataFrame([
        (1, 0, 0, "main", 32, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 0, 1, "main", 0, 0.99, 9.0, 9.0, 9.0, 9.0), (1, 0, 2, "main", 32, 0.9, 4.0, 4.0, 6.0, 6.0),
        (1, 1, 0, "main", 32, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 1, 1, "ball", 0, 0.2, 4.0, 4.0, 6.0, 8.0), (1, 2, 0, "main", 0, 0.9, 0.0, 0.0, 2.0, 2.0)],
        "clip_id long, frame long, det_ord long, model string, class_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    classes = spark.createDataFrame([("m", "ball", 32), ("m", "player", 0)], "model_id string, role string, class_id long")
    got = {r.frame: (r.ball_x, r.ball_y) for r in tracking.best_ball(df, classes).collect()}
    assert got == {0: (1.0, 1.0), 1: (5.0, 6.0)}


def test_class_names(spark):
    df = spark.createDataFrame([("a", 0, "Football"), ("a", 1, "GoalKeeper"), ("a", 2, "referee"), ("b", 7, "person"), ("c", 3, "ball player")],
                               "model_id string, class_id long, name string")
    got = {(r.model_id, r.role, r.class_id) for r in tracking.resolve_classes(df).collect()}
    assert got == {("a", "ball", 0), ("a", "player", 1), ("b", "player", 0), ("b", "ball", 32), ("c", "ball", 3), ("c", "player", 0)}


def votes_setup(spark, nearest):
    """Players 1..3 stand 100 px apart; the ball sits on the given player in frame 6, 7, ... of ten."""
    players = spark.createDataFrame([(1, f, p, p, p * 100.0, 0.0) for f in range(10) for p in (1, 2, 3)], PLAYERS)
    ball = spark.createDataFrame([(1, f, 300.0, 0.0) for f in range(6)] + [(1, 6 + i, p * 100.0, 1.0) for i, p in enumerate(nearest)], BALL)
    return players, ball


def test_key_player_votes(spark):
    players, ball = votes_setup(spark, [2, 1, 1, 2])
    assert tracking.key_player(players, ball, clips(spark)).first().key_track_id == 2  # first voted wins the tie
    nobody = tracking.key_player(players, ball.filter("frame < 6"), clips(spark))
    assert nobody.count() == 0


def test_key_player_possession(spark):
    players, ball = votes_setup(spark, [1, 2, 3, 1])
    team = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (1, 1, 1)], "clip_id long, track_id long, team int")
    # both teams have two votes, team 1 was first
    assert tracking.key_player_possession(players, ball, clips(spark), team).first().key_track_id == 1
    only = team.filter("track_id <> 1")
    assert tracking.key_player_possession(players, ball, clips(spark), only).first().key_track_id == 2
    assert tracking.key_player_possession(players, ball, clips(spark), team.filter("false")).first().key_track_id == 1


def path(spark, pts):
    return spark.createDataFrame([(1, f, x, 0.0) for f, x in pts], "clip_id long, frame long, px double, py double")


@pytest.mark.parametrize("chunk", [1, 1000])
def test_metric_path_limits(spark, chunk):
    one = clips(spark, fps=1.0)
    r = stats.metric_path(path(spark, [(0, 0.0), (1, 12.0), (2, 24.5), (3, 25.5)]), one, chunk=chunk).first()
    assert (r.distance_m, r.top_speed_kmh) == (13.0, pytest.approx(43.2))  # 12 counts, 12.5 does not
    r = stats.metric_path(path(spark, [(0, 0.0), (1, 6.25), (2, 8.25)]), clips(spark, fps=2.0), chunk=chunk).first()
    assert (r.distance_m, r.top_speed_kmh) == (8.25, pytest.approx(14.4))  # 45 km/h itself is out
    assert stats.metric_path(path(spark, [(0, 0.0)]), one, chunk=chunk).first().distance_m == 0.0


@pytest.mark.parametrize("chunk", [3, 1000])
def test_pixel_stats(spark, chunk):
    players = spark.createDataFrame([(1, f, 5, 0, f * 32.0, 0.0) for f in range(10)] + [(1, 0, 6, 1, 0.0, 0.0)], PLAYERS)
    key = spark.createDataFrame([(1, 5)], "clip_id long, key_track_id long")
    ball = spark.createDataFrame([(1, f, f * f * 32.0, 0.0) for f in range(6)], BALL)
    run = lambda fps: stats.pixel_shot(ball, clips(spark, fps=fps), chunk=chunk).first().shot_distance_m
    assert stats.pixel_distance(players, key, clips(spark), chunk=chunk).first().sprint_distance_m == pytest.approx(9.0)
    assert run(4.0) == pytest.approx(9.0)    # last two points
    assert run(1.0) == pytest.approx(25.0)   # int(fps // 2) = 0 means the whole path
    assert run(2.0) == 0.0                   # a single point
    assert run(60.0) == pytest.approx(25.0)


def beaten_by_hand(rows, key):
    own = {f: x for f, tid, _, x in rows if tid == key}
    series = {tid: [x - own[f] for f, t, _, x in sorted(rows) if t == tid and f in own] for _, tid, _, _ in rows if tid != key}
    passed = [tid for tid, rel in series.items() if any(a < 0 <= b for a, b in zip(rel, rel[1:]))]
    return min(6, len(passed))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [2, 1000])
def test_players_beaten(spark, seed, chunk):
    rnd = random.Random(seed)
    rows = [(f, t, t, rnd.uniform(-1, 1)) for f in range(12) for t in range(5) if rnd.random() < 0.6]
    df = spark.createDataFrame([(1, f, t, o, x, 0.0) for f, t, o, x in rows], PLAYERS)
    key = spark.createDataFrame([(1, 2)], "clip_id long, key_track_id long")
    assert stats.players_beaten(df, key, chunk=chunk).first().players_beaten == beaten_by_hand(rows, 2)


def test_stats_mode_follows_coverage(spark):
    players = spark.createDataFrame([(1, f, 5, 0, f * 1.0, 0.0) for f in range(4)], PLAYERS)
    key = spark.createDataFrame([(1, 5)], "clip_id long, key_track_id long")
    ball = spark.createDataFrame([(1, f, float(f), 0.0) for f in range(4)], BALL)
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    for solved, metric in ((2, False), (3, True)):
        h = spark.createDataFrame([(1, f, unit if f < solved else None) for f in range(4)], "clip_id long, frame long, h array<double>")
        r = stats.clip_stats(players, ball, key, clips(spark, 4), h).first()
        assert r.metric is metric and (r.top_speed_kmh is not None) is metric
        assert r.sprint_distance_m == pytest.approx(2.0 if metric else 3 / 32)
    r = stats.clip_stats(players, ball, key.filter("false"), clips(spark, 4)).first()
    assert (r.metric, r.sprint_distance_m, r.players_beaten) == (False, None, 0)


def test_projection(spark):
    h = spark.createDataFrame([(1, 0, [1.0, 0.0, 5.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0]), (1, 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (1, 2, None)],
                              "clip_id long, frame long, h array<double>")
    pts = spark.createDataFrame([(1, f, 3.0, 4.0) for f in range(4)], "clip_id long, frame long, cx double, cy double")
    got = {r.frame: (r.px, r.py) for r in pitch.to_pitch(pts, h).collect()}
    assert got == {0: (4.0, 4.0), 1: (None, None), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("chunk", [2, 1000])
@pytest.mark.parametrize("every", [1, 3])
def test_homography_smoothing(spark, chunk, every):
    rnd = random.Random(4)
    solved = [None if rnd.random() < 0.4 or f < 2 else [rnd.random() for _ in range(9)] for f in range(40)]
    df = spark.createDataFrame([(1, f, h) for f, h in enumerate(solved)], "clip_id long, frame long, h array<double>")
    got = {r.frame: r.h for r in pitch.smooth_homography(df, every=every, chunk=chunk).collect()}
    held = {r.frame: r.h for r in pitch.carry_forward(df, every=every, chunk=chunk).collect()}
    last = plain = None
    for f, h in enumerate(solved):
        if f % every == 0 and h is not None:
            last = h if last is None else [0.8 * a + (1 - 0.8) * b for a, b in zip(last, h)]
            plain = h
        assert got[f] == (last if last is None else pytest.approx(last))
        assert held[f] == plain


def test_keypoints(spark):
    rows = [(1, 0, i, 1.0 + i, 1.0, 0.5) for i in range(4)] + [(1, 1, i, 1.0, 1.0, 0.5) for i in range(3)] + [
        (1, 1, 17, 1.0, 1.0, 0.9), (1, 1, 4, 0.0, 0.0, 0.9), (1, 1, 5, 1.0, 1.0, 0.49)]
    got = pitch.keypoint_matches(spark.createDataFrame(rows, "clip_id long, frame long, kp_idx int, x double, y double, conf double")).collect()
    assert {(r.frame, r.kp_idx, r.name) for r in got} == {(0, 0, "tl_corner"), (0, 1, "tr_corner"), (0, 2, "br_corner"), (0, 3, "bl_corner")}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_camera_follows_focus(spark, chunk):
    frames = spark.createDataFrame([(1, f) for f in range(8)], "clip_id long, frame long")
    players = spark.createDataFrame([(1, 3, 1, 0, 400.0, 0.0), (1, 3, 2, 1, 800.0, 0.0)], PLAYERS)
    ball = spark.createDataFrame([(1, 2, 1500.0, 0.0), (1, 5, 40.0, 0.0)], BALL)
    focus = [960.0, 960.0, 1500.0, 600.0, 600.0, 40.0, 40.0, 40.0]
    got = {r.frame: r for r in reframe.camera_path(frames, players, ball, clips(spark), alpha=0.5, chunk=chunk).collect()}
    c = focus[0]
    for f, x in enumerate(focus):
        c = x if f == 0 else 0.5 * c + 0.5 * x
        want = min(max(c, 304.0), 1920 - 304.0)
        assert (got[f].cx, got[f].x0, got[f].crop_w) == (pytest.approx(want), round(want - 304), 608)
    square = reframe.camera_path(frames, players, ball, clips(spark), aspect="16:9", mode="center").first()
    assert (square.cx, square.x0, square.crop_w) == (960.0, 0, 1920)


@pytest.mark.parametrize("chunk", [18, 1000])
def test_ball_trail(spark, chunk):
    ball = spark.createDataFrame([(1, f * 3, float(f), 0.0) for f in range(40)], BALL)
    got = telestration.ball_trail(ball, chunk=chunk).filter("frame = 90").orderBy("segment").collect()
    assert [(r.x0, r.x1, r.thickness) for r in got] == [(13 + i, 14 + i, max(1, int(4 * (i + 1) / 18))) for i in range(17)]


@pytest.mark.parametrize("chunk", [30, 1000])
def test_motion_path(spark, chunk):
    seen = [f for f in range(70) if f % 3]
    path = spark.createDataFrame([(1, f, float(f * f), -float(f)) for f in seen], "clip_id long, frame long, cx double, cy double")
    frames = spark.createDataFrame([(1, f) for f in range(70)], "clip_id long, frame long")
    got = {}
    for r in telestration.motion_path(path, frames, chunk=chunk).collect():
        got.setdefault(r.frame, {})[r.point] = r.x
    for f in range(70):
        pts = np.array([float(g * g) for g in seen if f - 30 <= g <= f])
        if len(pts) < 5:
            assert f not in got
            continue
        k = max(1, len(pts) // 6)
        ext = np.pad(pts, k, mode="reflect")
        want = [ext[k + i - k // 2:k + i - k // 2 + k].mean() for i in range(len(pts))]
        assert np.allclose([got[f][i] for i in range(len(pts))], want)


def test_torso(spark):
    df = spark.createDataFrame([(10.9, 20.9, 30.2, 120.9), (-50.0, 0.0, -1.0, 90.0), (0.0, -30.0, 9.0, 30.0)], "x1 double, y1 double, x2 double, y2 double")
    got = [(r.tx1, r.ty1, r.tx2, r.ty2) for r in teams.torso_box(df).collect()]
    assert got == [(10, 40, 30, 75), (0, 0, 9, 3)]


def test_jersey_hist(spark):
    px = [("a", 0.0, 0.0)] * 3 + [("a", 179.0, 255.0)] * 4 + [("a", 180.0, 3.0), ("b", 180.0, 0.0)]
    got = {(r.owner, r.bin): r.value for r in teams.jersey_hist(spark.createDataFrame(px, "owner string, h double, s double")).collect()}
    assert len(got) == 256
    assert (got[("a", 0)], got[("a", 127)], got[("a", 5)], got[("b", 0)]) == (0.6, 0.8, 0.0, 0.0)


def test_team_vote(spark):
    rows = [(1, 7, f, lab) for f, lab in enumerate([1, 0, 0, 1])] + [(1, 8, 0, 1), (1, 8, 1, 0), (1, 8, 2, 0)]
    got = {r.track_id: r.team for r in teams.team_vote(spark.createDataFrame(rows, "clip_id long, track_id long, frame long, label int")).collect()}
    assert got == {7: 1, 8: 0}


def lloyd_by_hand(x, cs):
    """Lloyd's passes from centres `cs` until no label moves; the sum of squares that is left, and the labels."""
    lab = None
    while True:
        gaps = np.array([((x - c) ** 2).sum(1) for c in cs])
        new = gaps.argmin(axis=0)
        if lab is not None and (new == lab).all():
            return gaps.min(axis=0).sum(), lab
        lab = new
        cs = [x[lab == i].mean(0) if (lab == i).any() else c for i, c in enumerate(cs)]


def starts_by_hand(x, places, k, n):
    chance = lambda s, j, p: (int(hashlib.md5(":".join(map(str, (s, j, *p))).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    for s in range(n):
        cs = [x[min(range(len(x)), key=lambda i: chance(s, 0, places[i]))]]
        for j in range(1, k):
            gap = np.min([((x - c) ** 2).sum(1) for c in cs], axis=0)
            pull = [math.log(chance(s, j, p)) / g if g > 0 else -math.inf for p, g in zip(places, gap)]
            cs.append(x[int(np.argmax(pull))] if max(pull) > -math.inf else cs[0])
        yield cs


@pytest.mark.parametrize(("k", "whole"), [(2, 100), (3, 100), (2, 0), (3, 30)])
def test_team_kmeans(spark, k, whole):
    rng = np.random.default_rng(0)
    rows, want, alone = [], {}, set()
    for clip, n in ((1, 40), (2, 25), (3, 5), (4, 90), (5, 12)) if whole else ((1, 40), (2, 25), (4, 90), (5, 12)):
        x = rng.normal(0, 1, (n, 4)) + np.where(np.arange(n)[:, None] % 2, 1.5, 0.0) if clip != 5 else np.ones((n, 4))
        rows += [(clip, i, i, [float(v) for v in r]) for i, r in enumerate(x)]
        if n >= 3 * k:
            ends = [lloyd_by_hand(x, cs) for cs in starts_by_hand(x, [(i, i) for i in range(n)], k, 5)]
            alone.add(len({round(e, 9) for e, _ in ends}))
            least = min(e for e, _ in ends)
            lab = next(lab for e, lab in ends if e <= least * (1 + 1e-9))
            number = {v: i for i, v in enumerate(dict.fromkeys(lab.tolist()))}
            want |= {(clip, i): number[v] for i, v in enumerate(lab.tolist())}
    assert max(alone) > 1  # the starts do end in different places
    df = spark.createDataFrame(rows, "clip_id long, frame long, track_id long, feature array<double>").repartition(4)
    got = {(r.clip_id, r.frame): r.label for r in teams.team_kmeans(df, k, whole=whole, chunk=8).collect()}
    assert got == want and set(Counter(got.values())) == set(range(k))


def test_teams_feed_the_key_player(spark):
    from matchlytics.operators.scoreboard import stride
    from matchlytics.plans import highlights
    rng = np.random.default_rng(1)
    feats = [(1, f, t, [float(t % 2) * 5 + float(rng.normal(0, 0.1)), 0.0]) for f in range(6) for t in (1, 2, 3)]
    team = highlights.teams_of_tracks(spark.createDataFrame(feats, "clip_id long, frame long, track_id long, feature array<double>"))
    got = {r.track_id: r.team for r in team.collect()}
    assert got[1] == got[3] != got[2]
    players, ball = votes_setup(spark, [2, 2, 3, 1])
    # team of 1 and 3 ties with team of 2, which was first
    assert tracking.key_player_possession(players, ball, clips(spark), team).first().key_track_id == 2
    assert [r.frame for r in stride(ball, 4).orderBy("frame").collect()] == [0, 4, 8]


def test_best_ball_keeps_models_apart(spark):
    classes = spark.createDataFrame([("a", "ball", 1), ("b", "ball", 7), ("b", "player", 1)], "model_id string, role string, class_id long")
    df = spark.createDataFrame([("c", 0, 0, "main", "b", 1, 0.9, 0.0, 0.0, 2.0, 2.0), ("c", 0, 1, "main", "b", 7, 0.5, 4.0, 4.0, 6.0, 6.0)],
                               "clip_id string, frame int, det_ord int, model string, model_id string, class_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.ball_x, r.ball_y) for r in tracking.best_ball(df, classes).collect()] == [(5.0, 5.0)]
