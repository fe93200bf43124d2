import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlytics.functions.numbers import round_exact
from matchlytics.functions.text import parse_minute, parse_score, suffix
from matchlytics.operators import audio, commentary, scenes, scoreboard


def test_round_exact_is_python_round(spark):
    xs = [k / 2000 for k in range(2001)] + [0.6 * k / 10000 for k in range(10001)] + [0.0625, 0.4505, 0.5055]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_exact(F.col("x"), 3).alias("r")).collect()
    assert all(r.r == round(r.x, 3) for r in got)


@pytest.mark.parametrize("text,score,minute", [
    ("ABC 2-1 67'", (2, 1), 2), ("2 : 1", (2, 1), 2), ("3v0", (3, 0), None), ("10 V 9", (10, 9), 10),
    ("67' AB", None, 67), ("1234 5", None, 5), ("131 12", None, None), ("130", None, 130), ("", None, None),
    ("a-b", None, None), ("123-4", None, 123), ("12-345", None, 12)])
def test_parse(spark, text, score, minute):
    r = spark.createDataFrame([(text,)], "x string").select(parse_score(F.col("x")).alias("s"), parse_minute(F.col("x")).alias("m")).first()
    assert (tuple(r.s) if r.s else None, r.m) == (score, minute)


def test_minute_after_score(spark):
    r = spark.createDataFrame([("ABC 2-1 67'",)], "x string").select(parse_minute(F.col("x"), after_score=True).alias("m")).first()
    assert r.m == 67


def test_suffix(spark):
    rows = spark.createDataFrame([("a/b.MP4",), ("a.b/c",), ("a/.mp4",), ("x.tar.gz",)], "p string")
    assert [r[0] for r in rows.select(suffix(F.col("p"))).collect()] == [".mp4", "", "", ".gz"]


def scores_by_hand(reads):
    """Hops from each accepted reading to the next one that is a single goal away."""
    reads, at, out = sorted(reads), 0, []
    while True:
        _, _, h, a, _ = reads[at]
        hops = [i for i in range(at + 1, len(reads)) if reads[i][2:4] in ((h + 1, a), (h, a + 1))]
        if not hops:
            return out
        at = hops[0]
        t, _, h2, a2, minute = reads[at]
        out.append((t, f"{h2}-{a2}", f"{h}-{a}", minute))


def run_scores(spark, reads, **kw):
    df = spark.createDataFrame([("m", *r) for r in reads], "match_id string, t double, seq long, home int, away int, minute int")
    out = scoreboard.score_changes(df, **kw).orderBy("t", "seq").collect()
    return [(r.t, r.score, r.prev, r.minute) for r in out]


def reading(*pairs):
    return [(float(i), i, h, a, i) for i, (h, a) in enumerate(pairs)]


def test_score_jumps(spark):
    assert run_scores(spark, reading((0, 0), (1, 1), (1, 2))) == []
    assert run_scores(spark, reading((0, 0), (2, 0), (1, 0))) == [(2.0, "1-0", "0-0", 2)]
    assert run_scores(spark, reading((0, 99), (1, 0))) == []


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("chunk_seconds", "chunk"), [(3.0, 512), (1000.0, 512), (1000.0, 4)])
def test_score_changes_any_chunking(spark, seed, chunk_seconds, chunk):
    rnd = random.Random(seed)
    h = a = 0
    pairs = []
    for _ in range(300):
        step = rnd.random()
        h, a = (h + 1, a) if step < 0.05 else (h, a + 1) if step < 0.1 else (h, a)
        pairs.append((h, a) if rnd.random() < 0.8 else (max(0, h + rnd.choice([-1, 0, 1])), max(0, a + rnd.choice([-1, 0, 2]))))
    reads = reading(*pairs)
    assert run_scores(spark, reads, chunk_seconds=chunk_seconds, chunk=chunk) == scores_by_hand(reads)


def changes_by_scan(reads):
    base, out = None, []
    for t, _, h, a, minute in sorted(reads):
        if base is None:
            base = (h, a)
        elif (h, a) in ((base[0] + 1, base[1]), (base[0], base[1] + 1)):
            out.append((t, f"{h}-{a}", f"{base[0]}-{base[1]}", minute))
            base = (h, a)
    return out


@pytest.mark.parametrize("fan", [1, 2, 16])
def test_score_changes_over_composed_maps(spark, fan):
    """Several matches of unequal length, with more groups than one row chains."""
    rnd, rows, want = random.Random(5), [], []
    for m, n in (("a", 1), ("b", 40), ("c", 700)):
        reads = [(float(i), i, i // 40 + rnd.choice([0, 0, 0, 1, 2, 5]), i // 55 + rnd.choice([0, 0, 0, 1, 3]), rnd.randint(0, 90)) for i in range(n)]
        rows += [(m, *r) for r in reads]
        want += [(m, *c) for c in changes_by_scan(reads)]
    df = spark.createDataFrame(rows, "match_id string, t double, seq long, home int, away int, minute int").repartition(3)
    got = scoreboard.score_changes(df, chunk_seconds=100.0, chunk=5, fan=fan)
    assert sorted((r.match_id, r.t, r.score, r.prev, r.minute) for r in got.collect()) == sorted(want) and len(want) > 10


def test_one_match_of_many_noisy_readings(spark):
    rnd = random.Random(8)
    reads = [(i / 10, i, rnd.randint(0, 99), rnd.randint(0, 99), None) for i in range(200_000)]
    want = changes_by_scan(reads)
    assert run_scores(spark, reads) == want and len(want) > 20


def peaks_by_hand(peaks, gap):
    """Takes the earliest peak, lets it absorb or lose to what follows within the gap, and goes on after that."""
    queue, kept = collections.deque(sorted(peaks)), []
    while queue:
        top = queue.popleft()
        while queue and queue[0][0] - top[0] < gap:
            top = max(top, queue.popleft(), key=lambda p: p[1])  # max() keeps the first on ties
        kept.append(top)
    return kept


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk_seconds", [25.0, 40.0, 9000.0])
def test_merge_peaks_any_chunking(spark, seed, chunk_seconds):
    rnd = random.Random(seed)
    peaks, t = [], 0.0
    for _ in range(200):
        t += rnd.choice([1.0, 3.5, 12.0, 24.5, 25.0, 60.0])
        peaks.append((t, rnd.choice([2.5, 3.0, 3.5, rnd.random() + 3])))
    df = spark.createDataFrame([("m", *p) for p in peaks], "match_id string, t double, z double")
    got = audio.merge_peaks(df, chunk_seconds=chunk_seconds).orderBy("t").collect()
    assert [(r.t, r.z) for r in got] == peaks_by_hand(peaks, 25.0)


@pytest.mark.parametrize("chunk", [8, 70, 100000])
@pytest.mark.parametrize("gap", [0, 1, 40])
def test_loudness_chain(spark, chunk, gap):
    place = [i + gap * (i // 3) for i in range(400)]
    rng = np.random.default_rng(0)
    rms = rng.uniform(0, 1, 400) ** 3
    rms[50:60] = 0.0
    df = spark.createDataFrame([("m", place[i], i * 0.5, float(x)) for i, x in enumerate(rms)], "match_id string, idx long, t double, rms double")
    db = 20 * np.log10(np.maximum(1e-5, rms + 1e-9))
    db = np.maximum(db, db.max() - 80)
    smooth = np.convolve(db, np.ones(6) / 6, mode="same")
    z = np.array([(smooth[i] - np.median(w)) / (np.std(w) + 1e-6) for i in range(400) for w in [smooth[max(0, i - 30):i + 31]]])
    out = audio.smoothed_z(audio.loudness_db(df, chunk=chunk), "db", smooth=6, baseline=60, chunk=chunk)
    got = out.orderBy("idx").toPandas()
    assert np.allclose(got["db"], db) and np.allclose(got["smooth"], smooth) and np.allclose(got["z"], z)
    split = audio.rolling_z(audio.moving_avg(audio.loudness_db(df), "db", 6, chunk=chunk), "smooth", 60, chunk=chunk).orderBy("idx").toPandas()
    assert np.allclose(split["z"], z)
    peaks = audio.audio_peaks(out, thr=1.5, chunk=chunk).orderBy("idx").collect()
    runs = [list(g) for high, g in itertools.groupby(range(400), key=lambda i: z[i] > 1.5) if high]
    want = [(max(run, key=lambda i: (z[i], -i)), len(run)) for run in runs]
    assert [(p.idx, p.n) for p in peaks] == [(place[i], n) for i, n in want]


def test_rms_envelope(spark):
    rng = np.random.default_rng(1)
    for n, frame, hop in ((100, 16, 6), (97, 20, 10), (33, 8, 8), (5, 8, 4)):
        x = rng.uniform(-1, 1, n)
        df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "match_id string, idx long, x double")
        padded = np.pad(x, frame // 2)
        want = [np.sqrt(np.mean(padded[i:i + frame] ** 2)) for i in range(0, len(padded) - frame + 1, hop)]
        got = audio.rms_envelope(df, frame=frame, hop=hop).orderBy("hop_no").collect()
        assert [g.hop_no for g in got] == list(range(len(want))) and np.allclose([g.rms for g in got], want)


@pytest.mark.parametrize("size", [10.0, 25.0, 1000.0])
def test_replay_clusters(spark, size):
    lengths = [5, 12, 12, 20, 3, 3, 13, 1, 1, 1, 1, 1, 1, 1]
    rows, t = [], 0.0
    for i, d in enumerate(lengths):
        rows.append(("m", i, t, t + d))
        t += d
    df = spark.createDataFrame(rows, "match_id string, seq long, start_s double, end_s double")
    got = scenes.replay_clusters(df, bucket_seconds=size).orderBy("t").collect()
    assert [(g.t, g.strength, g.short_scenes) for g in got] == [(0.0, 0.5, 3), (68.0, 1.0, 7)]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_runs_in_any_chunking(spark, size):
    from matchlytics.functions.ordered import chunk_no, runs

    rnd, rows, want = random.Random(size), [], []
    for k, n, share in (("a", 300, 0.7), ("b", 40, 1.0), ("c", 30, 0.0), ("d", 1, 1.0)):
        mine = [(k, p, rnd.random() < share or None if rnd.random() < 0.9 else False) for p in sorted(rnd.sample(range(4 * n), n))]
        rows += mine
        for hit, group in itertools.groupby(mine, key=lambda r: bool(r[2])):
            group = list(group)
            want += [(k, len(group), group[0][1])] if hit else []
    df = spark.createDataFrame(rows, "k string, p long, hit boolean").repartition(3)
    assert sorted((r.k, r.n, r.p) for r in runs(df, "k", ["p"], F.col("hit"), ["p"], bucket=chunk_no("p", size)).collect()) == sorted(want)


def test_keywords(spark):
    df = spark.createDataFrame([("m", 1, 3.0, "  What a POSTponed goal, saved!\n"), ("m", 2, 4.0, None), ("m", 3, 5.0, "x" * 200 + " var")],
                               "match_id string, seq long, start_s double, text string")
    got = {(r.seq, r.kind_hint): (r.phrase, r.strength, r.text) for r in commentary.keyword_signals(df).collect()}
    assert got == {(1, "goal"): ("goal", 0.7, "What a POSTponed goal, saved!"), (1, "chance"): ("saved", 0.5, "What a POSTponed goal, saved!"),
                   (3, "card"): ("var", 0.5, "x" * 120)}
    whole = commentary.keyword_signals(df, {"chance": ["post"]}, whole_word=True)
    assert whole.count() == 0


def test_spots(spark):
    df = spark.createDataFrame([("m", 1.0, "Goal", 0.5), ("m", 2.0, "GOAL", 0.49), ("m", 3.0, "Corner", 1.7), ("m", 4.0, "Offside", 0.9)],
                               "match_id string, t double, label string, conf double")
    got = sorted((r.t, r.kind_hint, r.strength) for r in commentary.spot_signals(df, {"offside": "card"}).collect())
    assert got == [(1.0, "goal", 0.5), (3.0, "chance", 1.0), (4.0, "card", 0.9)]


def test_sampling_and_region(spark):
    df = spark.createDataFrame([(i, f) for f in (0.0, 25.0, 29.97) for i in (0, 125, 149, 150)], "idx long, fps double")
    got = {(r.idx, r.fps) for r in scoreboard.sample_frames(df).collect()}
    assert got == {(0, 0.0), (125, 0.0), (0, 25.0), (125, 25.0), (0, 29.97), (149, 29.97)}
    box = scoreboard.roi_box(spark.createDataFrame([(1281, 719)], "width int, height int")).first()
    assert (box.roi_x1, box.roi_y1, box.roi_x2, box.roi_y2) == (0, 0, 704, 129)
