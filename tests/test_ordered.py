import math
"""Chunked ordered operations against plain Python, with chunks small enough to be crossed many times."""

import random

import pytest
from pyspark.sql import functions as F

from matchlytics.functions.ordered import (carry_last, chunk_no, ema, following, islands, previous, running_sum,
                                           with_halo, with_position)
from matchlytics.functions.ranges import dyadic, points_in_intervals


def data(seed, hot=60):
    rnd = random.Random(seed)
    rows = []
    for key, n in (("hot", hot), ("a", 7), ("b", 1)):
        at = 0
        for _ in range(n):
            at += rnd.choice([1, 1, 1, 2, 5])
            rows.append((key, at, rnd.choice([None, rnd.random() * 10]), rnd.randint(0, 3)))
    rnd.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[1, 4, 1000])
def size(request):
    return request.param


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(data(3), "k string, p long, v double, i int").repartition(3)


def test_position_sum_neighbours_carry(frame, size):
    bucket = chunk_no("p", size)
    out = with_position(frame, "k", ["p"], bucket=bucket, total="n")
    out = running_sum(out, "k", ["p"], {"s": F.col("i")}, bucket=bucket)
    out = previous(out, "k", ["p"], ["p", "v"], bucket=bucket)
    out = following(out, "k", ["p"], ["v"], bucket=bucket)
    out = carry_last(out, "k", ["p"], "v", bucket=bucket, name="held")
    got = {(r.k, r.p): r for r in out.collect()}
    assert len(got) == 68
    for k, rows in by_key(data(3)).items():
        total, held = 0, None
        for j, (_, p, v, i) in enumerate(rows):
            r = got[(k, p)]
            total += i
            held = v if v is not None else held
            assert (r.pos, r.n, r.s, r.held) == (j, len(rows), total, held)
            assert (r.prev_p, r.prev_v) == ((rows[j - 1][1], rows[j - 1][2]) if j else (None, None))
            assert r.next_v == (rows[j + 1][2] if j + 1 < len(rows) else None)


def test_islands(frame, size):
    best = F.struct(F.col("i"), (-F.col("p")).alias("neg"))
    got = {(r.k, r["first"]): (r["last"], r.n, r.best.i, -r.best.neg) for r in islands(frame, "k", "p", best, size=size).collect()}
    want = {}
    for k, rows in by_key(data(3)).items():
        run = []
        for r in rows + [(k, 10**9, None, 0)]:
            if run and r[1] != run[-1][1] + 1:
                top = max(run, key=lambda x: (x[3], -x[1]))
                want[(k, run[0][1])] = (run[-1][1], len(run), top[3], top[1])
                run = []
            run.append(r)
    assert got == want


def test_halo_copies_are_complete(spark):
    rows = spark.range(50).withColumnRenamed("id", "p").withColumn("k", F.lit("x"))
    out = with_halo(rows, "k", "p", size=7, before=3, after=2)
    got = {}
    for r in out.collect():
        got.setdefault(r._chunk, set()).add(r.p)
    for c in range(8):
        assert got[c] >= {p for p in range(50) if c * 7 - 3 <= p < (c + 1) * 7 + 2}
    assert out.filter("_own").count() == 50


@pytest.mark.parametrize("keep", [0.0, 0.05, 0.85, 1.0])
def test_ema_matches_loop(spark, keep):
    rnd = random.Random(5)
    xs = [rnd.uniform(-500, 2000) for _ in range(5000)]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(xs)] + [("d", 0, 4.0)], "k string, p long, x double")
    got = {(r.k, r.p): r.y for r in ema(df, "k", "p", {"x": "y"}, keep=keep).collect()}
    y = xs[0]
    for i, x in enumerate(xs):
        y = x if i == 0 else keep * y + (1 - keep) * x
        assert got[("c", i)] == pytest.approx(y, abs=1e-8)
    assert got[("d", 0)] == 4.0


def test_interval_join_is_closed_and_complete(spark):
    rnd = random.Random(2)
    pts = [("h", float(rnd.randint(0, 400)) / 4) for _ in range(200)]
    ivs = [("h", i, a := float(rnd.randint(0, 90)), a + rnd.choice([0.0, 0.25, 3.0, 40.0])) for i in range(40)]
    p = spark.createDataFrame(pts, "k string, t double")
    i = spark.createDataFrame(ivs, "k string, n int, s double, e double")
    got = sorted((r.t, r.n) for r in points_in_intervals(p, i, by="k", t="t", start="s", end="e", width=5.0).collect())
    assert got == sorted((t, n) for _, t in pts for _, n, s, e in ivs if s <= t <= e)


def test_over_pairs_and_last_rows(frame, size):
    from matchlytics.functions.ordered import last_rows, over_pairs
    values = lambda a, b: {"gap": ("sum", b["p"] - a["p"]), "jump": ("max", b["i"] - a["i"]), "never": ("sum", F.when(b["p"] < a["p"], b["p"]))}
    got = {r.k: (r.gap, r.jump, r.never) for r in over_pairs(frame, "k", ["p"], ["p", "i"], values, bucket=chunk_no("p", size)).collect()}
    for k, rows in by_key(data(3)).items():
        pairs = list(zip(rows, rows[1:]))
        assert got[k] == ((sum(b[1] - a[1] for a, b in pairs), max(b[3] - a[3] for a, b in pairs), None) if pairs else (None, None, None))
    n = F.when(F.col("k") == "hot", 5).when(F.col("k") == "a", None).otherwise(3)
    tail = sorted((r.k, r.p) for r in last_rows(frame, "k", "p", n, bucket=chunk_no("p", size)).collect())
    want = [(k, r[1]) for k, rows in by_key(data(3)).items() for r in (rows[-5:] if k == "hot" else rows)]
    assert tail == sorted(want)


def test_key_row_reaches_every_row(frame, spark, size):
    from matchlytics.functions.ordered import with_key_row
    dim = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, w int")
    got = {(r.k, r.p): r.w for r in with_key_row(frame, dim, "k", bucket=chunk_no("p", size)).collect()}
    assert got == {(k, p): {"hot": 1, "b": 2}[k] for k, p, _, _ in data(3) if k != "a"}
    kept = with_key_row(frame, dim, "k", bucket=chunk_no("p", size), how="left", chunk="part").collect()
    assert len(kept) == 68 and all(r.part == r.p // size and (r.w is None) == (r.k == "a") for r in kept)


def test_hot_key_spreads_over_partitions(spark):
    from matchlytics.functions.ordered import with_key_row
    rows = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("p"))
    dim = spark.createDataFrame([("hot", 1)], "k string, w int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (with_key_row(rows, dim, "k", bucket=chunk_no("p", 500)), with_position(rows, "k", ["p"], bucket=chunk_no("p", 500)),
                    with_halo(rows.join(dim, "k"), "k", "p", size=500, before=3)):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 12000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dyadic_ranges_cover_their_cells_once(spark):
    rnd = random.Random(3)
    cells = [(a, a + n) for a in range(-9, 10) for n in range(0, 20)] + [(a, a + rnd.randint(0, 10**6)) for a in rnd.sample(range(-10**6, 10**6), 40)] + [(3, 2), (0, 10**6)]
    df = spark.createDataFrame(cells, "a long, b long").select("a", "b", dyadic(F.col("a"), F.col("b")).alias("r"))
    for a, b, found in df.collect():
        if a > b:
            assert not found
            continue
        spans = sorted((r.place << r.level, (r.place + 1) << r.level) for r in found)
        assert spans[0][0] == a and spans[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= max(1, 2 * math.log2(b - a + 1))


def test_long_intervals_make_few_rows(spark):
    """Intervals of a million seconds beside short ones, and points at both ends."""
    rnd = random.Random(4)
    spans = [("k", 0.0, 1e6, 0), ("k", 3.5, 3.5, 1), ("k", -50.0, 2.0, 2), ("j", 10.0, 10.5, 3), ("k", 5.0, 4.0, 4)]
    spans += [("k", s, s + rnd.choice([0.0, 1.0, 70.0, 5e5]), 5 + i) for i, s in enumerate(rnd.uniform(-100, 1e6) for _ in range(60))]
    times = [("k", t) for t in [0.0, 1e6, 3.5, 2.0, -50.0, *(rnd.uniform(-100, 1.2e6) for _ in range(200))]] + [("j", 10.5), ("x", 1.0)]
    p = spark.createDataFrame(times, "k string, t double")
    i = spark.createDataFrame(spans, "k string, s double, e double, n int")
    found = points_in_intervals(p, i, by="k", t="t", start="s", end="e", width=1.0)
    assert sorted((r.k, r.t, r.n) for r in found.collect()) == sorted((k, t, n) for k, t in times for j, s, e, n in spans if j == k and s <= t <= e)
    assert points_in_intervals(p, i.filter("n < 0"), by="k", t="t", start="s", end="e").collect() == []
