import functools
import json
import operator
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from matchlytics.config import BrandConfig, ReelConfig
from matchlytics.functions.ordered import chunk_no
from matchlytics.operators import captions, effects, overlays, reel, reframe
from matchlytics.sources import logs, media, state


def greedy_by_hand(items, target, top, cap):
    """Always the next item in line that still fits, as long as the reel is short of its target."""
    line = [(o, min(d, cap) if cap else d) for _, o, d in sorted(items, key=lambda i: (-i[0], i[1]))]
    taken = []
    length = lambda: functools.reduce(operator.add, (d for _, d in taken), 0.0)
    while not taken or length() < target:
        fits = [i for i, (_, d) in enumerate(line) if not taken or length() + d <= top]
        if not fits:
            break
        taken.append(line[fits[0]])
        line = line[fits[0] + 1:]
    return sorted(o for o, _ in taken)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("chunk", [3, 1024])
def test_select_reel(spark, seed, chunk):
    rnd = random.Random(seed)
    cfg = rnd.choice([ReelConfig(), ReelConfig(20, 25), ReelConfig(45, 60, 12.0), ReelConfig(50, 40), ReelConfig(0, 10)])
    reels = {r: [(rnd.choice([0.5, 0.7, rnd.random()]), i, rnd.choice([0.0, 3.0, 14.0, 30.0, 70.0, rnd.uniform(1, 60)])) for i in range(n)]
             for r, n in (("hot", 200), ("b", 5), ("c", 1))}
    df = spark.createDataFrame([(r, i, c, d) for r, its in reels.items() for c, i, d in its], "reel_id string, ord long, confidence double, duration double")
    got = {}
    for row in reel.select_reel(df, cfg, chunk=chunk).orderBy("reel_id", "slot").collect():
        got.setdefault(row.reel_id, []).append(row.ord)
    assert got == {r: greedy_by_hand(its, cfg.target, cfg.max_seconds, cfg.per_item) for r, its in reels.items()}


def test_hot_reel_of_falling_durations(spark):
    """Durations that fall along the confidence: chunk after chunk may hold an item that fits. No row is longer than a chunk."""
    n, cfg = 100_000, ReelConfig(45.0, 60.0)
    items = [(1.0 - i / n, i, 90.0 * (1 - i / n) ** 3) for i in range(n)]
    df = spark.range(n, numPartitions=4).select(F.lit("hot").alias("reel_id"), F.col("id").alias("ord"), (1.0 - F.col("id") / n).alias("confidence"),
                                                (90.0 * (1 - F.col("id") / n) ** 3).alias("duration"))
    total, want = 0.0, []
    for _, o, d in items:
        if want and total + d > cfg.max_seconds:
            continue
        total += d
        want.append(o)
        if total >= cfg.target:
            break
    assert [r.ord for r in reel.select_reel(df, cfg, chunk=1000).orderBy("slot").collect()] == want
    longest = [0]
    kept = reel.cut_lineage

    def watched(frame):
        out = kept(frame)
        if "_i" in out.columns:
            longest[0] = max(longest[0], out.agg(F.max(F.size("_i"))).first()[0])
        return out

    reel.cut_lineage = watched
    try:
        short = df.withColumn("duration", F.col("duration") / 100)
        total, picked = 0.0, 0
        for _, _, d in items:
            if picked and total + d / 100 > cfg.max_seconds:
                continue
            total, picked = total + d / 100, picked + 1
            if total >= cfg.target:
                break
        assert reel.select_reel(short, cfg, chunk=20).count() == picked and 0 < longest[0] <= 20
    finally:
        reel.cut_lineage = kept


def test_first_item_may_exceed_maximum(spark):
    df = spark.createDataFrame([("r", 0, 0.9, 90.0), ("r", 1, 0.8, 5.0)], "reel_id string, ord long, confidence double, duration double")
    assert [r.ord for r in reel.select_reel(df).collect()] == [0]


def test_reel_timeline_and_caption(spark):
    df = spark.createDataFrame([("r", 0, 0.9, 20.0, "goal"), ("r", 1, 0.8, 26.0, "chance")], "reel_id string, ord long, confidence double, duration double, kind string")
    chosen = reel.select_reel(df)
    got = [(r.part, r.start_s, r.end_s) for r in reel.reel_timeline(chosen).orderBy("part_no").collect()]
    assert got == [("intro", 0, 1), ("segment", 1, 21), ("segment", 21, 47), ("outro", 47, 48)]
    assert overlays.reel_caption(chosen).first().caption.startswith("1 GOALS IN 60S breakdown — Spot the defender's mistake 👀\n\n#football")
    assert overlays.reel_caption(chosen.filter("kind <> 'goal'")).first().caption.startswith("1 MOMENTS IN 60S")


def test_clip_timeline(spark):
    df = spark.createDataFrame([(1, 10.0)], "clip_id long, duration double")
    got = [(r.part, r.start_s, r.end_s) for r in reel.clip_timeline(df).orderBy("part_no").collect()]
    assert got == [("intro", 0.0, 1.0), ("freeze", 1.0, 2.2), ("body", 2.2, 12.2), ("outro", 12.2, 13.2)]
    assert [r.part for r in reel.clip_timeline(df, with_cards=False).orderBy("part_no").collect()] == ["freeze", "body"]


def test_slow_motion(spark):
    rows = [(1, 10.0, 5.0), (2, 3.9, 2.0), (3, 10.0, 0.0), (4, 10.0, 99.0), (5, 4.0, 3.9)]
    got = {r.clip_id: (r.slow_from, r.slow_to) for r in effects.slowmo_window(spark.createDataFrame(rows, "clip_id long, duration double, key_t double")).collect()}
    assert got[1] == (3.75, 6.25) and got[2] == (None, None) and got[3] == (0.4, 2.9)
    assert got[4] == (None, None)  # 9.5 .. 9.6 is too short
    assert got[5] == (pytest.approx(2.65), pytest.approx(3.6))


def test_time_remap(spark):
    windows = effects.slowmo_window(spark.createDataFrame([(1, 10.0, 5.0), (2, 2.0, 1.0)], "clip_id long, duration double, key_t double"))
    events = spark.createDataFrame([(1, t) for t in (1.0, 3.75, 5.0, 6.25, 8.0)] + [(2, 1.5)], "clip_id long, event_t double")
    got = {(r.clip_id, r.event_t): (r.out_t, r.out_duration) for r in effects.time_remap(events, windows).collect()}
    assert [got[(1, t)][0] for t in (1.0, 3.75, 5.0, 6.25, 8.0)] == pytest.approx([1.0, 3.75, 6.875, 10.0, 11.75])
    assert got[(1, 1.0)][1] == pytest.approx(13.75) and got[(2, 1.5)] == (1.5, 2.0)


def test_freeze_and_cuts(spark):
    r = effects.freeze_plan(spark.createDataFrame([(0.05, 3.0)], "duration double, key_t double")).first()
    assert (r.grab_t, r.freeze_s, r.freeze_frames) == (0.0, 1.2, 36)
    m = spark.createDataFrame([("m", 20.0, 9.0, 27.0, "goal"), ("m", 3.0, 3.0, 3.2, "card")], "match_id string, t double, start_s double, end_s double, kind string")
    got = [(c.name, c.duration, c.key_t) for c in effects.cut_list(m).orderBy("clip_no").collect()]
    assert got == [("clip_00_card", 0.5, 0.0), ("clip_01_goal", 18.0, 11.0)]


@pytest.mark.parametrize("size", [1, 100])
def test_caption_lines(spark, size):
    words = [(1, t, i, f" w{t}{i}", t * 10.0 + i, t * 10.0 + i + 0.5) for t in range(3) for i in range(3)] + [(2, 0, 0, " a", 0.0, 1.0)]
    df = spark.createDataFrame(words, "clip_id long, turn long, pos long, word string, start_s double, end_s double").repartition(3)
    got = captions.caption_lines(df, bucket=chunk_no("turn", size)).orderBy("clip_id", "line_no").collect()
    assert [(r.clip_id, r.text, r.start_s, r.end_s) for r in got] == [
        (1, "w00 w01 w02 w10", 0.0, 10.5), (1, "w11 w12 w20 w21", 11.0, 21.5), (1, "w22", 22.0, 22.5), (2, "a", 0.0, 1.0)]


def test_caption_schedule_counts_blank_lines(spark):
    df = spark.createDataFrame([(1, 0, "GOLAZO! 100%: top corner", 0.2, 1.5), (1, 1, "  ", 1.5, 1.6), (1, 2, None, 1.5, 1.6), (1, 3, " watch [this] run", 1.6, 2.6)],
                               "clip_id long, line_no long, text string, start_s double, end_s double")
    got = [(r.draw_no, r.text, r.from_s, r.to_s) for r in captions.caption_schedule(df).orderBy("draw_no").collect()]
    assert got == [(0, "GOLAZO! 100%: top corner", "0.20", "1.50"), (3, "watch [this] run", "1.60", "2.60")]


def test_round_robin(spark):
    df = spark.createDataFrame([("m", k, float(i)) for i, k in enumerate(["goal", "save", "goal", "chance", "goal", "goal"])], "match_id string, kind string, t double")
    got = captions.round_robin(df, {"goal": ["a", "b", "c"], "chance": ["x"], "skill": []}, bucket=chunk_no("t", 2.0)).orderBy("t").collect()
    assert [r.pick for r in got] == ["a", "a", "b", "x", "c", "a"]
    assert captions.round_robin(df, [], by="match_id", bucket=chunk_no("t", 2.0)).first().pick is None


def overlay_row(spark, **kw):
    base = dict(clip_id=1, kind="goal", minute=67, hook="Spot it 👀, [test]: 100%", metric=False, sprint_distance_m=40.0, top_speed_kmh=None,
                shot_distance_m=24.0, players_beaten=2)
    schema = ("clip_id long, kind string, minute int, hook string, metric boolean, sprint_distance_m double, top_speed_kmh double, "
              "shot_distance_m double, players_beaten long")
    row = {**base, **kw}
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


def test_overlays(spark):
    got = overlays.overlay_schedule(overlay_row(spark)).orderBy("overlay_no").collect()
    assert [(r.text, r.t0, r.t1, r.y_offset) for r in got] == [
        ("Spot it 👀, [test]: 100%", 0.0, 1.6, 0), ("GOAL  -  67'", None, None, 0), ("Shot: ~24 m", None, None, 0), ("Sprint: ~40 m", None, None, 70),
        ("Beaten: 2", None, None, 140), ("@yourchannel", None, None, 0)]
    got = overlays.overlay_schedule(overlay_row(spark, minute=None, metric=True, shot_distance_m=0.0, sprint_distance_m=2.5, top_speed_kmh=31.5,
                                                players_beaten=0, hook=None)).orderBy("overlay_no").collect()
    assert [(r.text, r.y_offset) for r in got] == [("GOAL", 0), ("Sprint: 2 m", 0), ("Top speed: 32 km/h", 70), ("Beaten: 0", 140), ("@yourchannel", 0)]
    got = overlays.overlay_schedule(overlay_row(spark, metric=None), BrandConfig(show_watermark=False, show_hook=False, show_minute=False)).collect()
    assert [r.text for r in got] == ["GOAL"]


def test_clip_caption(spark):
    df = spark.createDataFrame([("goal",), ("card",)], "kind string")
    a, b = (r.caption for r in overlays.clip_caption(df).collect())
    assert a == "GOAL breakdown — Spot the defender's mistake 👀\n\n#football #soccer #goal #highlights #tactics"
    assert b.startswith("CARD breakdown — \n\n")


def test_run_summary_and_documents(spark):
    clips = spark.createDataFrame([("a", 0, "goal", 0.9, 1.0, None, "ok"), ("a", 1, "card", 0.5, 2.0, 3, "failed"), ("b", 0, "card", 0.5, 2.0, 3, "failed")],
                                  "match_id string, clip_no long, kind string, confidence double, t double, minute int, status string")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "match_id string")
    summary = overlays.run_summary(clips, runs)
    got = {r.match_id: (r.moments, r.goals, r.n_ok, r.n_failed, r.status) for r in summary.collect()}
    assert got == {"a": (2, 1, 1, 1, "ok"), "b": (1, 0, 0, 1, "failed"), "c": (0, 0, 0, 0, "empty")}
    docs = {r.match_id: json.loads(r.document) for r in state.result_documents(summary, clips).collect()}
    assert [c["clip_no"] for c in docs["a"]["clips"]] == [0, 1] and docs["a"]["clips"][0]["minute"] is None and docs["c"]["clips"] is None


def test_config_overlay_is_a_deep_merge(spark):
    base = {"a.b": "1", "a.c.d": "2", "a.c.e": "3", "f": "4", "g.h": "5"}
    over = {"a.c.d": "20", "f.x": "40", "g": "50", "new.y": "60"}
    df = lambda d: spark.createDataFrame([("m", k, v) for k, v in d.items()], "match_id string, path string, value string")
    got = {r.path: r.value for r in overlays.config_overlay(df(base), df(over)).collect()}
    assert got == {"a.b": "1", "a.c.d": "20", "a.c.e": "3", "f.x": "40", "g": "50", "new.y": "60"}


def deep_merge(a, b):
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return b
    return {k: deep_merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}


def test_nested_documents_are_merged(spark):
    rnd = random.Random(9)

    def doc(depth):
        kinds = [lambda: rnd.randint(0, 9), lambda: None, lambda: "x.y", lambda: [1, {"k": doc(1)}], lambda: {}, lambda: True]
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(kinds)()
        return {rnd.choice(["a", "b", "c.d", "é"]): doc(depth - 1) for _ in range(rnd.randint(0, 3))}

    pairs = [(doc(4), doc(4)) for _ in range(80)] + [({"a": {"b": 1}}, {"a": {}}), ({"a": 5}, {"a": {}}), ({"a": {}}, {"a": {"b": 2}}), ({"l": [1, 2]}, {"l": [3]})]
    df = lambda side: (spark.createDataFrame([(i, json.dumps(p[side])) for i, p in enumerate(pairs)], "match_id long, j string")
                       .select("match_id", F.parse_json("j").alias("settings")))
    got = overlays.merge_documents(df(0).filter("match_id <> 1"), df(1).filter("match_id <> 2")).select("match_id", F.to_json("settings").alias("j"))
    found = {r.match_id: json.loads(r.j) for r in got.collect()}
    want = {i: b if i == 1 else a if i == 2 else deep_merge(a, b) for i, (a, b) in enumerate(pairs)}
    assert found == want


def test_overlay_of_any_leaves(spark):
    """Leaves below leaves, repeated ones and null keys, against the definition: one join per rule."""
    rnd = random.Random(4)
    leaf = lambda i: (rnd.choice([1, 2, None]), ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) if rnd.random() < 0.95 else None, f"v{i}")
    base, over = [leaf(i) for i in range(90)], [leaf(100 + i) for i in range(12)]
    own = lambda r: r[0] is not None and r[1] is not None
    below = lambda r, s: own(r) and own(s) and r[0] == s[0] and r[1].startswith(s[1] + ".")
    kept = [b for b in base if not any(below(b, o) or below(o, b) for o in over)]
    want = []
    for o in over:
        want += [(*o, True)] * max(1, sum(own(b) and b[:2] == o[:2] for b in kept))
    want += [(*b, False) for b in kept if not any(own(b) and b[:2] == o[:2] for o in over)]
    kind = "match_id long, path string, value string"
    got = overlays.config_overlay(spark.createDataFrame(base, kind), spark.createDataFrame(over, kind))
    text = lambda rows: sorted(map(str, rows))
    assert text((r.match_id, r.path, r.value, r.overridden) for r in got.collect()) == text(want)


def test_leaves_of_a_document_are_moved_and_kept_once(spark, monkeypatch):
    kind = "match_id long, path string, value string"
    got = overlays.config_overlay(spark.createDataFrame([(1, "a.b", "1")], kind), spark.createDataFrame([(1, "a", "2")], kind))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    kept, cut = [], overlays.cut_lineage
    monkeypatch.setattr(overlays, "cut_lineage", lambda df: kept.append(1) or cut(df))
    docs = lambda js: spark.createDataFrame([(1, js)], "match_id long, j string").select("match_id", F.parse_json("j").alias("settings"))
    merged = overlays.merge_documents(docs('{"a":{"b":{"c":{"d":1}}}}'), docs('{"a":{"b":{"e":2}}}'))
    assert json.loads(merged.select(F.to_json("settings")).first()[0]) == {"a": {"b": {"c": {"d": 1}, "e": 2}}}
    assert len(kept) == 1


def test_deep_and_missing_documents(spark):
    """More levels than are opened at a time, keys without a document, and keys of one table only."""
    deep, other = 7, 6
    for n in range(6):
        deep, other = {"k": deep, f"b{n}": n}, {"k": other, f"o{n}": n}
    rows = lambda *js: spark.createDataFrame(list(js), "match_id long, j string").select("match_id", F.parse_json("j").alias("settings"))
    got = overlays.merge_documents(rows((1, json.dumps(deep)), (2, None), (3, "null"), (5, "{}")), rows((1, json.dumps(other)), (2, None), (4, "5"), (5, None)))
    found = {r.match_id: r.j and json.loads(r.j) for r in got.select("match_id", F.to_json("settings").alias("j")).collect()}
    assert found == {1: deep_merge(deep, other), 2: None, 3: None, 4: 5, 5: {}}
    assert {r.match_id: r.no for r in got.select("match_id", F.col("settings").isNull().alias("no")).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


@pytest.mark.parametrize("js,want", [
    ('{"format":{"duration":"9.5"},"streams":[{"codec_type":"video","width":1,"height":2,"avg_frame_rate":"25/1"},{"codec_type":"video","width":1280,"height":720,"avg_frame_rate":"30000/1001"},{"codec_type":"video"}]}',
     (9.5, 1280, 720, 30000 / 1001, False)),
    ('{"format":{},"streams":[{"codec_type":"audio"},{"codec_type":"video","width":4,"height":3}]}', (0.0, 4, 3, 30.0, True)),
    ('{"format":{"duration":"1"},"streams":[{"codec_type":"video","width":4,"height":3,"avg_frame_rate":"0/0"}]}', (1.0, 4, 3, 30.0, False)),
    ('{"format":{"duration":"1"},"streams":[{"codec_type":"video","width":4,"height":3,"avg_frame_rate":"50/"}]}', (1.0, 4, 3, 50.0, False)),
    ('{"format":{"duration":"1"},"streams":[]}', (1.0, None, None, None, False)), ("not json", (0.0, None, None, None, False))])
def test_probe(spark, js, want):
    r = media.probe_media(spark.createDataFrame([(1, js)], "media_id long, js string")).first()
    assert (r.duration, r.width, r.height, r.fps, r.has_audio) == want


def test_triage(spark):
    lines = [("a", i, s) for i, s in enumerate(["Error: x", "fine", "Error: x", "file Not Found"] + [f"unable {i}" for i in range(12)])]
    lines += [("b", i, f"line {i}") for i in range(20)]
    got = {}
    for r in logs.triage_log(spark.createDataFrame(lines, "run_id string, line_no long, line string")).orderBy("run_id", "line_no").collect():
        got.setdefault(r.run_id, []).append(r.line)
    assert got == {"a": [f"unable {i}" for i in range(12)], "b": [f"line {i}" for i in range(8, 20)]}


def test_catalog_and_lists(spark, tmp_path):
    for name in ("x/b.MP4", "x/a.txt", "x/c.mp4", "y/d.mkv", "y/e.doc"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("12345")
    files = media.read_file_catalog(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    assert [r.path for r in media.list_inputs(files).collect()] == ["x/b.MP4", "x/c.mp4", "y/d.mkv"]
    assert [r.path for r in media.list_outputs(files).collect()] == ["x/b.MP4", "x/c.mp4", "x/a.txt"]
    gone = media.delete_matches(files, spark.createDataFrame([("x",)], "dir string"))
    assert {r.dir for r in gone.collect()} == {"y"}
    totals = {(r["dir"], r.path): (r.level, r.mb) for r in media.file_manifest(files).collect()}
    assert totals[(None, None)] == (3, 25e-6) and totals[("y", None)] == (1, 1e-5) and len(totals) == 8


def test_catalog_of_many_files_is_not_held_by_the_driver(spark, tmp_path):
    for d in range(3):
        (tmp_path / f"d{d}").mkdir()
    for i in range(9000):
        (tmp_path / "d0" / f"{i}.mp4").write_bytes(b"x" * (1 + i % 7))
    (tmp_path / "d1" / "y.mkv").write_text("12")
    files = media.read_file_catalog(spark, str(tmp_path))
    assert len(files.inputFiles()) < 20  # of the kept names, whatever the number of files
    rows = files.collect()
    assert len({r.path for r in rows}) == len(rows) == 9001
    assert sum(r.size for r in rows) == sum(1 + i % 7 for i in range(9000)) + 2 and {r["dir"] for r in rows} == {"d0", "d1"}


def test_local_catalog_follows_the_rules_of_spark(spark, tmp_path):
    top = tmp_path / "t [1]"
    for name in ("b.MP4", "a/_x.mp4", "a/_x=1.mp4", "a/.h.mp4", "a/z._COPYING_", "a/_metadata.mp4", "_hid/x.mp4", ".hid/x.mp4", "_metadata_d/x.mp4", "_p=1/x.mp4",
                 "a/deep/er/q.mp4", "a/é %41+.ts", "a/new\nline.mp4", "a/x.mp4\n", "a/co:lon.mkv", "a/{q}?[1]*.avi", "sub.mp4/in.txt", "real/r.mp4"):
        p = top / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text("12345")
    (top / "a/empty.mp4").touch()
    (top / "none").mkdir()
    (top / "a/link").symlink_to("../real")
    (top / "a/l.mp4").symlink_to("../real/r.mp4")
    (top / "a/broken.mp4").symlink_to("nowhere")
    (top / "a/circle.mp4").symlink_to("circle.mp4")
    open(os.fsencode(top / "a") + b"/\xff.mp4", "w").write("1")
    for path, glob in ((tmp_path / "t*", "*"), (tmp_path, "*.{mp4,MKV}"), (tmp_path / "t*/{a,real,a/deep}", "[!x]*"), (tmp_path / "t*/b.MP4", "*"), (tmp_path / "t*/_hid", "x.*"), (tmp_path / "t*/none", "*")):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(str(path)).select("path", "length")
        got = media.read_file_catalog(spark, str(path), glob).select("path", "size", "dir").collect()
        assert sorted((r.path, r["size"]) for r in got) == sorted((r.path, r["length"]) for r in want.collect())
        assert all(r["dir"] == r.path.split("/")[-2] for r in got)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        media.read_file_catalog(spark, str(tmp_path / "gone"))


def test_resume(spark, tmp_path):
    keys = spark.createDataFrame([(i,) for i in range(4)], "match_id long")
    calls = []

    def compute(left):
        calls.append(sorted(r.match_id for r in left.collect()))
        return left.withColumn("x", F.col("match_id") * 2)

    run = lambda ks, h: sorted((r.match_id, r.x) for r in state.load_or_compute(spark, str(tmp_path / "s"), ks, compute, config_hash=h).collect())
    assert run(keys.filter("match_id < 2"), "h1") == [(0, 0), (1, 2)]
    assert run(keys, "h1") == [(0, 0), (1, 2), (2, 4), (3, 6)]
    assert run(keys.filter("match_id = 1"), "h2") == [(1, 2)]
    assert calls == [[0, 1], [2, 3], [1]]


def test_of_two_runs_at_once_one_saves_a_key(spark, tmp_path):
    """A second run starts and ends while the first one computes: every key is saved once, by the run that published it first."""
    keys, path = spark.createDataFrame([(i,) for i in range(4)], "match_id long"), str(tmp_path / "s")

    def slow(left):
        state.load_or_compute(spark, path, keys.filter("match_id in (1, 2)"), lambda x: x.withColumn("x", F.lit("second")), config_hash="h")
        return left.withColumn("x", F.lit("first"))

    got = sorted((r.match_id, r.x) for r in state.load_or_compute(spark, path, keys, slow, config_hash="h").collect())
    assert got == [(0, "first"), (1, "second"), (2, "second"), (3, "first")]


def test_versions_are_published_once(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "v"))
    assert store.read() is None and store.delete(spark.range(1), by="id") == 0
    assert store.append(spark.range(3)) == 1
    before = store.read()
    folder = store.write(spark.range(3, 5))
    assert store.read().count() == 3  # written, not published
    version, folders, schema = store.latest()
    store.publish(version + 1, [*folders, folder], schema)
    with pytest.raises(state.Conflict):
        store.publish(version + 1, folders, schema)
    assert sorted(r.id for r in store.read().collect()) == [0, 1, 2, 3, 4]
    assert store.delete(spark.range(1, 2), by="id") == 3 and sorted(r.id for r in store.read().collect()) == [0, 2, 3, 4]
    assert folder in store.latest()[1]  # holds nothing that was deleted
    assert sorted(r.id for r in before.collect()) == [0, 1, 2]  # an older version can still be read
    assert store.delete(spark.range(10), by="id") == 4 and store.read().count() == 0


def test_writers_race_for_a_version(spark, tmp_path):
    import threading

    path, won = str(tmp_path / "r" / "_versions" / "1"), []

    def run(i):
        try:
            state.put_if_absent(spark, path, f"{i}" * 1000)
            won.append(i)
        except state.Conflict:
            pass

    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and open(path).read() == str(won[0]) * 1000


def test_other_file_systems_publish_by_rename(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./v", f"file://{tmp_path}")
    store = state.Store(spark, "viewfs://store/v/s")
    store.append(spark.range(2))
    version, folders, schema = store.latest()
    with pytest.raises(state.Conflict):
        store.publish(version, folders, schema)
    assert store.append(spark.range(2, 4)) == 2 and store.read().count() == 4


def test_saved_files_are_listed_by_name(spark, tmp_path):
    rows = [("a b", "x=1.mp4", "né"), ("a b", "y+%.MKV", ""), ("c", "z.txt", "1\n2")]
    media.save_files(spark.createDataFrame(rows, "dir string, name string, body string"), str(tmp_path / "f"))
    files = media.read_file_catalog(spark, str(tmp_path / "f"))
    assert sorted((r["dir"], r.path, r.size) for r in files.collect()) == [("a b", "a b/x=1.mp4", 4), ("a b", "a b/y+%.MKV", 1), ("c", "c/z.txt", 4)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_many_saved_files_take_no_process_each(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("if(id % 2 = 0, 'a', null) as dir", "concat('_', id div 2, '\"{.mp4') as name", "if(id = 0, null, 'é') as body")
    start = time.monotonic()
    media.save_files(rows.unionByName(rows.limit(1)), str(tmp_path / "f"))
    assert time.monotonic() - start < 20
    files = {(r["dir"], r.path): r.size for r in media.read_file_catalog(spark, str(tmp_path / "f")).collect()}
    assert len(files) == 12_000 and files["a", 'a/_0"{.mp4'] == 2 and files["__HIVE_DEFAULT_PARTITION__", '__HIVE_DEFAULT_PARTITION__/_5999"{.mp4'] == 3
    with pytest.raises(Exception, match="exist"):
        media.save_files(rows, str(tmp_path / "f"))


def test_rows_of_one_name_are_saved_in_one_file(spark, tmp_path):
    rows = spark.range(4000).selectExpr("case id % 4 when 0 then '' when 1 then null else 'd' end as dir", "if(id % 4 = 3, '', concat('n', id div 4 % 50)) as name", "concat('b', id) as body")
    media.save_files(rows.repartition(7), str(tmp_path / "f"))
    assert sorted(os.listdir(tmp_path / "f")) == ["dir=__HIVE_DEFAULT_PARTITION__", "dir=d"]
    want = {}
    for r in rows.collect():  # null and empty go by one name
        want.setdefault((r["dir"] or "__HIVE_DEFAULT_PARTITION__", r.name or "__HIVE_DEFAULT_PARTITION__"), []).append(r.body)
    got = {(d[4:], f[5:]): (tmp_path / "f" / d / f).read_text().splitlines() for d in os.listdir(tmp_path / "f") for f in os.listdir(tmp_path / "f" / d)}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sizes = {r.path: r.size for r in media.read_file_catalog(spark, str(tmp_path / "f")).collect()}
    assert sizes == {"/".join(k): sum(len(x) + 1 for x in v) for k, v in want.items()}


def test_naming_of_staged_files_can_be_repeated(spark, tmp_path):
    import pyarrow as pa

    staged, root = tmp_path / "s", tmp_path / "f"
    (staged / "0").mkdir(parents=True)
    found = pa.RecordBatch.from_pydict({"target": ["dir=a/name=x", "dir=a/name=x", "dir=a/name=y", "dir=b/name=z"], "attempt": [0] * 4, "n": range(4)})
    for i in range(4):
        (staged / f"0/{i}").write_text(f"{i}\n")

    def attempt(_):  # in a task, which knows its attempt
        made = media._naming(str(root), str(staged))
        return [next(made(iter([found]))).to_pydict()["files"]]

    for left in ([], [], [0], [1, 3]):  # parts that an attempt before did not come to remove, or that were written again
        for i in left:
            (staged / f"0/{i}").write_text(f"{i}\n")
        assert spark.sparkContext.parallelize([0], 1).mapPartitions(attempt).collect() == [[3]]
        assert [(root / p).read_text() for p in ("dir=a/name=x", "dir=a/name=y", "dir=b/name=z")] == ["0\n1\n", "2\n", "3\n"]
        assert os.listdir(staged / "0") == []
    os.unlink(root / "dir=b/name=z")
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.sparkContext.parallelize([0], 1).mapPartitions(attempt).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a\nb{i}") for i in range(50)], "match_id long, caption string")
    state.write_results(df, str(tmp_path / "r"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 50
    state.write_captions(df, str(tmp_path / "c"))
    back = spark.read.schema("match_id long, caption string").json(str(tmp_path / "c"))
    assert sorted((r.match_id, r.caption) for r in back.collect()) == [(i, f"a\nb{i}") for i in range(50)]


def test_finished_length_and_letterbox(spark):
    df = spark.createDataFrame([(10.0, 5.0), (3.0, 1.0)], "duration double, key_t double")
    assert sorted(round(r.duration, 6) for r in effects.finished_length(df).collect()) == [4.2, 14.95]
    box = reframe.letterbox(spark.createDataFrame([(1920, 1080), (500, 1000)], "width int, height int"))
    assert sorted(tuple(r)[2:] for r in box.collect()) == [(960, 1920, 60, 0), (1080, 608, 0, 656)]


def test_missing_files(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    p = spark.createDataFrame([("a", 5), ("b", 0)], "path string, size long")
    assert sorted(r.path for r in state.missing_files(t, p).collect()) == ["b", "c"]
