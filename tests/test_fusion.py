import functools
import operator
import random

import pytest

from matchlytics.config import FusionConfig, MomentConfig, PadConfig
from matchlytics.operators import fusion

SCHEMA = "match_id string, t double, seq long, source string, strength double, kind_hint string, phrase string, minute int"


def sig(t, seq, source="audio", strength=1.0, hint=None, phrase=None, minute=None, match="m"):
    return (match, float(t), seq, source, float(strength), hint, phrase, minute)


def moments(spark, rows, duration=3000.0, cfg=None):
    signals = spark.createDataFrame(rows, SCHEMA).repartition(3)
    durations = signals.select("match_id").distinct().selectExpr("match_id", f"double({duration}) as duration")
    return fusion.detect_moments(signals, durations, cfg).orderBy("match_id", "t", "start_s").collect()


def test_two_audio_spikes(spark):
    got = moments(spark, [sig(10, 0), sig(28, 1)], 40.0, MomentConfig(pads=PadConfig(3, 2, 3, 2)))
    assert [(g.t, g.start_s, g.end_s, g.confidence, g.kind) for g in got] == [(10, 7, 12, 0.6, "chance"), (28, 25, 30, 0.6, "chance")]


def test_gap_boundary_is_inclusive(spark):
    rows = [sig(0, 0), sig(8, 1), sig(16.0000001, 2), sig(24.1, 3), sig(24.1, 4), sig(40, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.cluster for r in fusion.cluster_signals(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_anchor_without_score_change_is_not_zero(spark):
    got = moments(spark, [sig(500, 0, strength=0.9), sig(503, 1, strength=1.0), sig(504, 2, strength=1.0)])
    assert [g.t for g in got] == [503.0]
    got = moments(spark, [sig(700, 0, "commentary", 1.0, "card"), sig(701, 1, "scene")])
    assert [(g.t, g.kind, g.sources) for g in got] == [(700.0, "card", ["commentary", "scene"])]
    got = moments(spark, [sig(3, 0, "scoreboard_ocr", minute=12), sig(1, 1)])
    assert [(g.t, g.kind, g.minute, g.start_s) for g in got] == [(0.0, "goal", 12, 0.0)]


@pytest.mark.parametrize("rows,kind", [
    ([("action_spotting", "chance", None), ("scoreboard_ocr", None, None)], "chance"),
    ([("action_spotting", "corner", None), ("scoreboard_ocr", None, None)], "goal"),
    ([("action_spotting", "save", None), ("action_spotting", "card", None)], "card"),
    ([("commentary", "chance", "close"), ("audio", None, "he saved it")], "save"),
    ([("commentary", "chance", "close"), ("audio", None, None)], "chance"),
    ([("commentary", "card", None), ("commentary", "goal", None)], "goal"),
    ([("audio", None, None)], "chance")])
def test_kinds(spark, rows, kind):
    got = moments(spark, [sig(100 + i, i, s, 1.0, h, p) for i, (s, h, p) in enumerate(rows)], cfg=MomentConfig(FusionConfig(min_confidence=0.0)))
    assert [g.kind for g in got] == [kind]


def test_threshold_before_rounding_and_weights(spark):
    # 0.6 * 0.75 is a little less than 0.45 in doubles
    assert moments(spark, [sig(10, 0, strength=0.75)]) == []
    assert len(moments(spark, [sig(10, 0, strength=0.7500001)])) == 1
    assert moments(spark, [sig(10, 0, "scene")]) == []
    assert len(moments(spark, [sig(10, 0, "scene")], cfg=MomentConfig(FusionConfig(weights={"scene": 0.5})))) == 1


def fuse_by_hand(rows, cap):
    """Independent restatement of clustering, scoring and ranking for one match."""
    w = FusionConfig().weights
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    cuts = [0, *[i for i in range(1, len(rows)) if rows[i][1] - rows[i - 1][1] > 8.0], len(rows)]
    out = []
    for no, group in enumerate(rows[a:b] for a, b in zip(cuts, cuts[1:])):
        order = list(dict.fromkeys(r[3] for r in group))
        shares = [w.get(s, 0.0) * max(r[4] for r in group if r[3] == s) for s in order]
        conf = min(1.0, functools.reduce(operator.add, shares, 0.0))
        minutes = [r[7] for r in group if r[7] is not None]
        if not conf < 0.45:
            out.append((-round(conf, 3), no, sorted(order), len(group), minutes[0] if minutes else None))
    return sorted((no, -c, s, n, m) for c, no, s, n, m in sorted(out)[:cap])


@pytest.mark.parametrize("seed", range(3))
def test_random_matches(spark, seed):
    rnd = random.Random(seed)
    kinds = ["audio", "scene", "scoreboard_ocr", "commentary", "action_spotting", "other"]
    rows = []
    for m in ("hot", "small"):
        t = 0.0
        for i in range(400 if m == "hot" else 9):
            t += rnd.choice([0.0, 0.5, 4.0, 8.0, 8.5, 30.0])
            rows.append(sig(t, i, rnd.choice(kinds), rnd.random(), minute=rnd.choice([None, 7]), match=m))
    got = moments(spark, rows, 1e6)
    for m in ("hot", "small"):
        want = fuse_by_hand([r for r in rows if r[0] == m], 25)
        mine = [(g.confidence, g.sources, g.signal_count, g.minute) for g in got if g.match_id == m]
        assert sorted(mine, key=repr) == sorted((w[1:] for w in want), key=repr)


def test_same_result_for_any_partitioning(spark):
    rnd = random.Random(9)
    rows = [sig(rnd.randint(0, 500), i, rnd.choice(["audio", "scoreboard_ocr", "commentary"]), rnd.random()) for i in range(300)]
    want = moments(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        rnd.shuffle(rows)
        assert moments(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_union_keeps_detector_order(spark):
    a = spark.createDataFrame([("m", 1.0, 0, "commentary", 0.5, "goal")], "match_id string, t double, seq long, source string, strength double, kind_hint string")
    b = spark.createDataFrame([("m", 1.0, "audio", 0.9)], "match_id string, t double, source string, strength double")
    got = fusion.all_signals(a, b).orderBy("t", "det", "seq").collect()
    assert [(r.source, r.det, r.kind_hint) for r in got] == [("audio", 0, None), ("commentary", 3, "goal")]


def test_limit(spark):
    df = spark.createDataFrame([("m", float(i), c) for i, c in enumerate([0.5, 0.9, 0.5, 0.7])], "match_id string, t double, confidence double")
    assert sorted(r.t for r in fusion.limit_moments(df, 3).collect()) == [0.0, 1.0, 3.0]
    assert fusion.limit_moments(df, 0).count() == 4
