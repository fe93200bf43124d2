import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlytics.operators import commentary, fusion, scoreboard
from matchlytics.streaming import live, replay

START = datetime(2024, 1, 1)
COLS = "match_id string, t double, seq long, source string, strength double, kind_hint string, phrase string, minute int, ts timestamp"


def write(df, path):
    df.write.parquet(path)
    return path


def test_live_moments_equal_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = []
    for m in "abc":
        t = 0.0
        for i in range(150):
            t += rnd.choice([0.5, 4.0, 8.0, 8.5, 20.0])
            src = rnd.choice(["audio", "scene", "scoreboard_ocr", "commentary", "action_spotting"])
            rows.append((m, t, i, src, rnd.random(), rnd.choice(["goal", "save", "card", "chance"]), rnd.choice([None, "saved"]), rnd.choice([None, 5]), START + timedelta(seconds=t)))
    batch = spark.createDataFrame(rows, COLS)
    far = spark.createDataFrame([("zz", 1e6, 0, "audio", 0.1, None, None, None, START + timedelta(days=30))], COLS)
    path = write(batch.unionByName(far).coalesce(1), str(tmp_path / "in"))
    got = replay.run_available(live.live_moments(replay.stream_table(spark, path)))
    fused = fusion.anchor_moments(fusion.classify_clusters(fusion.fuse_confidence(fusion.clusters(batch)))).filter("confidence >= 0.45")
    want = sorted((r.match_id, r.t, r.kind, r.signal_count, round(r.confidence, 3), r.minute or -1) for r in fused.collect())
    assert sorted((r.match_id, r.t, r.kind, r.signal_count, r.confidence, r.minute or -1) for r in got.collect()) == want and len(want) > 20


def test_live_scores_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for m in "ab":
        h = a = 0
        for i in range(200):
            h, a = (h + 1, a) if rnd.random() < 0.1 else (h, a + 1) if rnd.random() < 0.1 else (h, a)
            noise = rnd.choice([0, 0, 0, 1, 3])
            rows.append((m, float(i), i, h + noise, a, rnd.choice([None, i % 90]), START + timedelta(seconds=i)))
    schema = "match_id string, t double, seq long, home int, away int, minute int, ts timestamp"
    rnd.shuffle(rows)
    batch = spark.createDataFrame(rows, schema)
    far = spark.createDataFrame([("zz", 1e6, 0, 0, 0, None, START + timedelta(days=30))], schema)
    path = write(batch.unionByName(far).coalesce(1), str(tmp_path / "in"))
    got = replay.run_available(live.live_score_changes(replay.stream_table(spark, path)))
    pick = lambda df: sorted((r.match_id, r.t, r.seq, r.score, r.prev, -1 if r.minute is None else r.minute) for r in df.collect())
    want = pick(scoreboard.score_changes(batch))
    assert pick(got) == want and len(want) > 5


def test_live_scores_wait_for_late_rows_over_several_batches(spark, tmp_path):
    schema = "match_id string, t double, seq long, home int, away int, minute int, ts timestamp"
    at = lambda t, h, a: ("m", float(t), t, h, a, None, START + timedelta(seconds=t))
    parts = [[at(0, 0, 0), at(20, 2, 0)], [at(10, 1, 0), at(90, 2, 0)], [at(5, 9, 9), at(100000, 0, 0)]]  # 5 s is too late by then
    folder, out = str(tmp_path / "in"), []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        q = (live.live_score_changes(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").outputMode("append")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
    out = sorted((r.t, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(10.0, "1-0"), (20.0, "2-0")]


def ends_of(spark, batch, path):
    """The end of every match, as a stream of its own."""
    return replay.stream_table(spark, write(batch.groupBy("match_id").agg(F.max("ts").alias("ts")).coalesce(1), path))


def test_ends_close_everything_and_remove_the_state(spark, tmp_path):
    """With the ends of the matches a stream gives what a batch gives, the last rows included, and keeps nothing."""
    rnd = random.Random(6)
    rows = []
    for m in "abc":
        t = 0.0
        for i in range(60):
            t += rnd.choice([0.5, 8.0, 8.5, 20.0])
            rows.append((m, t, i, rnd.choice(["audio", "scoreboard_ocr", "commentary"]), rnd.random(), "goal", None, rnd.choice([None, 5]), START + timedelta(seconds=t)))
    batch = spark.createDataFrame(rows, COLS)
    path = write(batch.coalesce(1), str(tmp_path / "in"))
    plan = live.live_moments(replay.stream_table(spark, path), ends=ends_of(spark, batch, str(tmp_path / "ends")))
    state = str(tmp_path / "state")
    plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    fused = fusion.anchor_moments(fusion.classify_clusters(fusion.fuse_confidence(fusion.clusters(batch)))).filter("confidence >= 0.45")
    want = sorted((r.match_id, r.t, r.kind, r.signal_count, round(r.confidence, 3), r.minute or -1) for r in fused.collect())
    assert sorted((r.match_id, r.t, r.kind, r.signal_count, r.confidence, r.minute or -1) for r in got.collect()) == want and len(want) > 20
    for name in ("waiting", "latest"):
        assert spark.read.format("statestore").option("stateVarName", name).load(state).count() == 0


def test_state_of_scores(spark, tmp_path):
    """Two matches, one of which ends: its baseline and readings are gone, those of the other one are kept."""
    schema = "match_id string, t double, seq long, home int, away int, minute int, ts timestamp"
    rows = [(m, float(i), i, i // 10, 0, i, START + timedelta(seconds=i)) for m in "ab" for i in range(60)]
    batch = spark.createDataFrame(rows, schema)
    path, state = write(batch.coalesce(1), str(tmp_path / "in")), str(tmp_path / "state")
    plan = live.live_score_changes(replay.stream_table(spark, path), ends=ends_of(spark, batch.filter("match_id = 'a'"), str(tmp_path / "ends")))
    plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.match_id, r.t, r.score, r.minute) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # of match b only what is older than the watermark, 30 s behind the last reading
    assert got == [("a", 10.0 * i, f"{i}-0", 10 * i) for i in range(1, 6)] + [("b", 10.0 * i, f"{i}-0", 10 * i) for i in (1, 2)]
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(state)
    assert {r.key.match_id for r in held("baseline").collect()} == {"b"}
    assert {r.key.match_id for r in held("waiting").collect()} == {"b"}


def test_idle_matches_are_forgotten(spark, tmp_path):
    schema = "match_id string, t double, seq long, home int, away int, minute int, ts timestamp"
    at = lambda m, t: (m, float(t), t, 0, 0, None, START + timedelta(seconds=t))
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in ([at("a", 0), at("b", 100)], [at("b", 8000)], [at("b", 8100)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        (live.live_score_changes(spark.readStream.schema(schema).parquet(folder), idle="1 hour").writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    held = spark.read.format("statestore").option("stateVarName", "latest").load(state)
    assert {r.key.match_id for r in held.collect()} == {"b"}


def test_keywords_are_stateless(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 3.0, "what a goal"), ("m", 2, 4.0, "nothing")], "match_id string, seq long, start_s double, text string")
    path = write(df, str(tmp_path / "in"))
    got = replay.run_available(commentary.keyword_signals(replay.stream_table(spark, path))).collect()
    assert [(r.seq, r.phrase) for r in got] == [(1, "goal")]


def test_live_loudness(spark, tmp_path):
    rows = [("m", START + timedelta(milliseconds=250 * i), float(i % 3)) for i in range(40)] + [("zz", START + timedelta(days=1), 0.0)]
    path = write(spark.createDataFrame(rows, "match_id string, ts timestamp, x double").coalesce(1), str(tmp_path / "in"))
    got = {r.from_ts: r.rms for r in replay.run_available(live.live_loudness(replay.stream_table(spark, path), rate=4.0)).filter("match_id = 'm'").collect()}
    for i in range(0, 36, 2):
        assert got[START + timedelta(milliseconds=250 * i)] == pytest.approx((sum((j % 3) ** 2 for j in range(i, i + 4)) / 4) ** 0.5)
    assert len(got) == 21


def test_live_loudness_closes_at_the_end(spark, tmp_path):
    rows = [(m, START + timedelta(milliseconds=250 * i), float(i % 3)) for m, n in (("m", 40), ("n", 7)) for i in range(n)]
    batch = spark.createDataFrame(rows, "match_id string, ts timestamp, x double")
    path = write(batch.coalesce(1), str(tmp_path / "in"))
    got = replay.run_available(live.live_loudness(replay.stream_table(spark, path), rate=4.0, ends=ends_of(spark, batch, str(tmp_path / "ends")))).collect()
    for m, n in (("m", 40), ("n", 7)):
        mine = {r.from_ts: r.rms for r in got if r.match_id == m}
        want = {START + timedelta(milliseconds=500 * h): sum((i % 3) ** 2 for i in range(max(0, 2 * h), min(n, 2 * h + 4))) for h in range(-1, (n + 1) // 2)}
        assert set(mine) == set(want) and all(mine[k] == pytest.approx((e / 4) ** 0.5) for k, e in want.items())


def test_isolated_failures(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None), ("c", "2")], "match_id string, raw string")
    good, errors = commentary.isolate_failures(df, F.col("raw").try_cast("int"), raw="raw", detector="d")
    assert sorted(r.value for r in good.collect()) == [1, 2]
    assert {r.match_id: (r.n_failed, r.status, r.first_error) for r in errors.collect()} == {"a": (1, "partial", "x"), "b": (1, "failed", ""), "c": (0, "ok", None)}


def test_spotter_that_raises_costs_only_its_own_signals(spark):
    def spotter(text):
        yield 1.0, "Goal", 0.9
        if "bad" in text:
            raise RuntimeError("no such player")
        yield 2.0, "Save", "0.8"

    commentary.register_spotter(spark, "brittle", spotter)
    df = spark.createDataFrame([("a", "fine"), ("b", "bad text"), ("b", "fine"), ("c", None)], "match_id string, text string")
    found = spark.sql("select s.match_id, f.* from {s} s, lateral brittle(s.text) f", s=df)
    spots, errors = commentary.split_spots(found, "brittle")
    signals = commentary.spot_signals(spots)
    assert sorted((r.match_id, r.t, r.kind_hint) for r in signals.collect()) == [("a", 1.0, "goal"), ("a", 2.0, "save"), ("b", 1.0, "goal"), ("b", 1.0, "goal"), ("b", 2.0, "save"), ("c", 1.0, "goal")]
    got = {r.match_id: (r.detector, r.n_failed, r.error) for r in errors.collect()}
    assert got["b"] == ("brittle", 1, "RuntimeError: no such player") and set(got) == {"b", "c"} and got["c"][2].startswith("TypeError")


def test_spotter_over_whole_matches(spark):
    class Runs:
        """Spots `length` rows in a row with the same word; fails at the word `bad`."""

        def __init__(self, settings):
            if settings.get("broken"):
                raise ValueError("no model")
            self.length, self.run, self.word, self.rows = settings["length"], 0, None, 0

        def see(self, row):
            self.rows += 1
            if row["text"] == "bad":
                raise KeyError("bad")
            self.run = self.run + 1 if row["text"] == self.word else 1
            self.word = row["text"]
            if self.run == self.length:
                yield row["at"], "Goal", 1.0

        def end(self):
            yield -1.0, "rows", self.rows

    commentary.register_match_spotter(spark, "runs", Runs)
    texts = {"a": "x x y y y x", "b": "x x x bad x x", "c": "y", "d": "bad"}
    rows = [(m, i, float(i), w) for m, t in texts.items() for i, w in enumerate(t.split())]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "game string, no long, at double, text string").repartition(5)
    call = lambda more="": spark.sql(f"""select * from runs(table({{s}}), '{{{{"by": "game", "order": "no", "length": 3{more}}}}}')""", s=df)
    spots, errors = commentary.split_spots(call(), "runs", by="game")
    assert sorted((r.game, r.t, r.label, r.conf) for r in spots.collect()) == [("a", -1.0, "rows", 6.0), ("a", 4.0, "Goal", 1.0), ("b", 2.0, "Goal", 1.0), ("c", -1.0, "rows", 1.0)]
    assert sorted((r.game, r.n_failed, r.error) for r in errors.collect()) == [("b", 1, "KeyError: 'bad'"), ("d", 1, "KeyError: 'bad'")]
    assert sorted((r.game, r.error) for r in call(', "broken": 1').collect()) == [(g, "ValueError: no model") for g in "abcd"]
    with pytest.raises(Exception, match="no column nope"):
        spark.sql("""select * from runs(table({s}), '{{"by": "nope"}}')""", s=df).collect()


def test_sessions_of_a_match_are_closed_together():
    """Work per session would take minutes here: 30,000 sessions of three signals."""
    n = 30_000
    t = np.repeat(np.arange(n) * 60.0, 3) + np.tile([0.0, 1.0, 2.0], n)
    rows = pd.DataFrame({"ms": (t * 1000).astype("int64"), "t": t, "rank": np.tile([0, 1, 2], n), "seq": np.arange(3 * n), "source": np.tile(["scene", "audio", "audio"], n),
                         "strength": np.tile([0.25, 0.5, 0.75], n), "bits": np.tile([1, 2, 4], n), "minute": pd.array(np.tile([None, 7, 8], n), dtype="Int64")})
    start = time.monotonic()
    out, wait = live.SessionRows(6.0, 1000).closed(rows, np.inf)
    assert time.monotonic() - start < 15
    assert len(out) == n and len(wait) == 0
    last = out.iloc[-1]
    assert (last.signal_count, last.labels, last.minute, last.audio_t, last.sources, last.strengths) == (3, 7, 7, t[-1], ["scene", "audio"], [0.25, 0.75])
    assert pd.isna(last.board_t) and last.opened == last.first_t == t[-3]


def test_windows_of_a_match_are_summed_together():
    """Work per window would take most of a minute here."""
    class Nothing:
        def get(self):
            return None

        def update(self, value):
            pass

    n = 200_000
    step = live.LoudnessRows(500, 2, 1000)
    step.sent = Nothing()
    hops = np.r_[np.arange(n), n + 5]
    rows = pd.DataFrame({"ms": hops * 500, "hop": hops, "energy": np.r_[np.arange(n, dtype=float), np.nan]})
    start = time.monotonic()
    out, wait = step.closed(rows, np.inf)
    assert time.monotonic() - start < 10
    got = dict(zip(out["hop"].tolist(), out["energy"].tolist()))
    assert len(wait) == 0 and len(got) == n + 3 and got[-1] == 0.0 and got[7] == 15.0 and got[n - 1] == n - 1.0 and got[n + 4] == got[n + 5] == 0.0
