"""Live forms of the operators for Structured Streaming.

Inputs carry `ts`, the event time (after the epoch), beside `t`, seconds in the match. A batch run may chain two sessions
over a late signal that a stream has already dropped: `delay` is the lateness a stream waits for.

Rows of a match wait in its state until the watermark has passed what they belong to. The watermark only moves with later rows, of
any match, so the last minutes of a match could wait for long: `ends` (key, ts) announces the ends of matches. An end closes
everything the match still holds and removes its state; it has to come with or after the last rows of the match. Matches
without one are forgotten `idle` after their last row by a timer. State is kept in RocksDB, rows of other matches
stay on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import FusionConfig
from ..functions.numbers import round_exact
from ..functions.ordered import keys_of
from ..operators.fusion import anchor_moments, classify_clusters, detector_rank, label_bits
from ..operators.scoreboard import HOME

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """Python value of a cell of a data frame, None for a missing one."""
    if value is None or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


class MatchRows(StatefulProcessor):
    """Holds the rows of a match (columns `fields`, `ms` among them) and closes them in order of time.

    `closed` gets the rows that wait and the time that has been reached, infinite at the end of the match, and gives the result of
    what is closed and the rows that go on waiting. It works on all rows of a match at once, not row by row or result by result.
    `hold` is how long after its time a row can be closed. `latest` is there as long as anything is kept of a match.
    """

    fields: dict[str, str] = {}

    def __init__(self, hold_ms: int, idle_ms: int):
        self.hold_ms, self.idle_ms = hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {kind}" for c, kind in self.fields.items()))
        self.latest = handle.getValueState("latest", "ms long")

    def closed(self, rows: pd.DataFrame, now: float) -> tuple[pd.DataFrame | None, pd.DataFrame]:
        raise NotImplementedError

    def forget(self) -> None:
        """Removes everything that is kept of the match."""
        self.waiting.clear()
        self.latest.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _waiting(self, *more: pd.DataFrame) -> pd.DataFrame:
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=list(self.fields))
        parts = [p for p in (held, *more) if len(p)]
        return self._typed(pd.concat(parts, ignore_index=True) if parts else held)

    def _typed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The columns `fields`, whole numbers as such: pandas makes them floats where some are missing."""
        cells = {}
        for c, kind in self.fields.items():
            x, plain = rows[c], isinstance(rows[c].dtype, np.dtype)
            if kind in ("int", "long") and not (plain and x.dtype.kind == "i"):
                if plain and x.dtype.kind == "f" and not np.isnan(x.to_numpy()).any():
                    x = x.astype("int64")
                else:
                    whole = x.astype("Int64")
                    x = whole if whole.isna().any() else whole.astype("int64")
            cells[c] = x
        return pd.DataFrame(cells)

    def _put(self, rows: pd.DataFrame, append: bool) -> None:
        rows = self._typed(rows)
        cells = [tuple(_plain(v) for v in r) for r in zip(*(rows[c].tolist() for c in self.fields))]
        if append:
            self.waiting.appendList(cells)
        elif cells:
            self.waiting.put(cells)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if frame.empty:
            return
        new = frame[~frame["ended"].to_numpy(dtype=bool)]
        if len(new) < len(frame):
            known = self.latest.exists()  # most often a match comes whole, and nothing is kept of it
            out, _ = self.closed(self._waiting(new) if known else self._typed(new), np.inf)
            if known:
                self.forget()
            if out is not None and len(out):
                yield self._keyed(key, out)
        elif len(new):
            self._put(new, append=True)
            last = max([int(new["ms"].max()), *(x for x in (self.latest.get() or ()) if x is not None)])
            self.latest.update((last,))
            for at in {int(new["ms"].min()) + self.hold_ms + 1, int(new["ms"].max()) + self.hold_ms + 1, last + self.idle_ms}:
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out, wait = self.closed(self._waiting(), now)
        self._put(wait, append=False)
        last = self.latest.get()
        if not len(wait) and last is not None and last[0] + self.idle_ms <= now:
            self.forget()
        if out is not None and len(out):
            yield self._keyed(key, out)

    @staticmethod
    def _keyed(key, out: pd.DataFrame) -> pd.DataFrame:
        out.insert(0, "_key", key[0])
        return out


def _per_match(rows: DataFrame, ends: DataFrame | None, by: str, delay: str, processor: MatchRows, out: str) -> DataFrame:
    """Runs a processor over rows (by, ts, fields) and the ends of matches."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = rows.withColumn("ended", F.lit(False))
    if ends is not None:
        rows = rows.unionByName(ends.select(by, "ts", F.lit(True).alias("ended")), allowMissingColumns=True)
    kind = dict(rows.dtypes)[by]
    rows = rows.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return (rows.groupBy(by).transformWithStateInPandas(processor, f"_key {kind}, {out}", "append", "eventTime")
            .withColumnRenamed("_key", by))


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


class SessionRows(MatchRows):
    """Signals of a match to sessions: a new one starts when a signal comes more than `gap` seconds after the one before."""

    fields = {"ms": "long", "t": "double", "rank": "int", "seq": "long", "source": "string", "strength": "double", "bits": "int", "minute": "int"}
    out = "opened double, signal_count long, first_t double, labels int, minute int, board_t double, audio_t double, sources array<string>, strengths array<double>"

    def __init__(self, gap: float, idle_ms: int):
        super().__init__(int(gap * 1000), idle_ms)
        self.gap = gap

    def closed(self, rows, now):
        rows = rows.sort_values(["t", "rank", "seq"], kind="stable", ignore_index=True)
        session = (rows["t"].diff() > self.gap).cumsum()
        open_ = rows["ms"].groupby(session).transform("max") + self.hold_ms >= now
        done = self._sessions(rows[~open_], session[~open_].to_numpy())
        return (pd.DataFrame(done, columns=[c.split()[0] for c in self.out.split(", ")]) if done else None), rows[open_]

    @staticmethod
    def _sessions(rows: pd.DataFrame, session: np.ndarray) -> list[tuple]:
        """The rows of `out`, one per session, of rows in order of time."""
        if rows.empty:
            return []
        new = np.r_[True, session[1:] != session[:-1]]
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        t, strength, source = rows["t"].to_numpy(dtype=float), rows["strength"].to_numpy(dtype=float), rows["source"]

        def firsts(values, where):
            """The value of the first of the rows `where` of each session, None where there is none or it is missing."""
            at, first = np.unique(of[where], return_index=True)
            found = dict(zip(at.tolist(), values[where][first].tolist(), strict=True))
            return [_plain(found.get(k)) for k in range(len(starts))]

        minute = rows["minute"].to_numpy(dtype=float, na_value=np.nan)
        audio = np.flatnonzero(source == "audio")
        audio = audio[np.lexsort((t[audio], -strength[audio], of[audio]))]  # the loudest first
        # the greatest strength of each source of a session, sources in order of appearance
        code, names = pd.factorize(source)
        known = np.flatnonzero(code >= 0)
        pair, first, place = np.unique(of[known] * max(len(names), 1) + code[known], return_index=True, return_inverse=True)
        strongest = np.full(len(pair), np.nan)
        np.fmax.at(strongest, place, strength[known])
        order = np.argsort(first, kind="stable")
        sources, strengths = [[] for _ in starts], [[] for _ in starts]
        for p, x in zip(pair[order].tolist(), strongest[order].tolist(), strict=True):
            sources[p // len(names)].append(names[p % len(names)])
            strengths[p // len(names)].append(x)
        opened = t[starts].tolist()
        bits = np.bitwise_or.reduceat(rows["bits"].to_numpy(dtype=np.int64), starts).tolist()
        minutes = [None if m is None else int(m) for m in firsts(minute, ~np.isnan(minute))]
        return list(zip(opened, np.diff(np.r_[starts, len(t)]).tolist(), opened, bits, minutes, firsts(t, np.flatnonzero(source == "scoreboard_ocr")),
                        firsts(t, audio), sources, strengths, strict=True))


def live_moments(signals: DataFrame, cfg: FusionConfig | None = None, *, by: str = "match_id", ends: DataFrame | None = None,
                 delay: str = "30 seconds", idle: str = "3 hours") -> DataFrame:
    """Scored, classified and anchored moments, each emitted once its session is closed by the watermark or by the end of its match."""
    cfg = cfg or FusionConfig()
    rows = signals.select(by, "ts", "t", detector_rank().alias("rank"), F.col("seq").cast("long").alias("seq"), "source", "strength",
                          label_bits().alias("bits"), F.col("minute").cast("int").alias("minute"))
    sessions = _per_match(rows, ends, by, delay, SessionRows(cfg.gap, _millis(idle)), SessionRows.out)
    weight = F.create_map(*[F.lit(x) for s, w in cfg.weights.items() for x in (s, float(w))])
    shares = F.zip_with("sources", "strengths", lambda s, x: F.coalesce(F.try_element_at(weight, s), F.lit(0.0)) * x)
    conf = F.least(F.lit(1.0), F.aggregate(shares, F.lit(0.0), lambda a, p: a + p))
    rows = sessions.withColumn("confidence", conf).filter(F.col("confidence") >= cfg.min_confidence)
    rows = rows.withColumn("audio", F.struct((-F.col("audio_t")).alias("nt")))
    rows = anchor_moments(classify_clusters(rows), backoff=cfg.anchor_backoff)
    return rows.select(by, "opened", "t", round_exact(F.col("confidence"), 3).alias("confidence"), "kind", "minute", "signal_count")


class ScoreRows(MatchRows):
    """Readings of a match to score changes: a baseline, and the readings that the watermark has not passed."""

    fields = {"ms": "long", "t": "double", "seq": "long", "code": "long", "minute": "int"}
    out = "t double, seq long, score string, prev string, minute int"

    def init(self, handle):
        super().init(handle)
        self.baseline = handle.getValueState("baseline", "code long")

    def forget(self):
        super().forget()
        self.baseline.clear()

    def closed(self, rows, now):
        open_ = rows["ms"] >= now
        ready = rows[~open_].sort_values(["t", "seq"], kind="stable")
        if ready.empty:
            return None, rows
        saved, out = self.baseline.get(), []
        base = saved[0] if saved else None
        # a reading that repeats the one before it changes nothing
        changed = ready[ready["code"] != ready["code"].shift()]
        for t, seq, code, minute in zip(changed["t"], changed["seq"], changed["code"], changed["minute"]):
            if base is None:
                base = int(code)
            elif code - base in (1, HOME):
                minute = _plain(minute)
                out.append((t, seq, f"{code // HOME}-{code % HOME}", f"{base // HOME}-{base % HOME}", None if minute is None else int(minute)))
                base = int(code)
        if now < np.inf:
            self.baseline.update((base,))
        found = pd.DataFrame(out, columns=["t", "seq", "score", "prev", "minute"]) if out else None
        return found, rows[open_]


def live_score_changes(reads: DataFrame, *, by: str = "match_id", ends: DataFrame | None = None, delay: str = "30 seconds", idle: str = "3 hours") -> DataFrame:
    """`score_changes` on a stream: readings wait for the watermark or the end of the match, then are taken in time order.

    Readings of one match depend on each other, so they share a task; a live scoreboard is read a few times a second at
    most. After `idle` without readings a match starts anew.
    """
    rows = reads.filter(F.col("home").isNotNull()).select(
        by, "ts", "t", F.col("seq").cast("long").alias("seq"), (F.col("home") * HOME + F.col("away")).cast("long").alias("code"),
        F.col("minute").cast("int").alias("minute"))
    return _per_match(rows, ends, by, delay, ScoreRows(0, _millis(idle)), ScoreRows.out)


class LoudnessRows(MatchRows):
    """Energies of a match per hop to RMS per window of `hops` hops; a window comes out when its last hop is over."""

    fields = {"ms": "long", "hop": "long", "energy": "double"}
    out = "hop long, energy double"

    def __init__(self, hop_ms: int, hops: int, idle_ms: int):
        super().__init__(hop_ms * hops, idle_ms)
        self.hop_ms, self.hops = hop_ms, hops

    def init(self, handle):
        super().init(handle)
        self.sent = handle.getValueState("sent", "hop long")

    def forget(self):
        super().forget()
        self.sent.clear()

    def _put(self, rows, append):
        # what waits is one sum per hop, however many samples there are
        super()._put(rows.groupby("hop", as_index=False).agg(ms=("ms", "max"), energy=("energy", "sum")), append)

    def closed(self, rows, now):
        sums = rows.groupby("hop")["energy"].sum()
        saved = self.sent.get()
        hop, value = sums.index.to_numpy(dtype=np.int64), sums.to_numpy(dtype=float)
        done = np.unique(np.concatenate([hop - k for k in range(self.hops)]))
        done = done[(done >= (-np.inf if saved is None else saved[0] + 1)) & ((done + self.hops) * self.hop_ms <= now)]
        if not len(done):
            return None, rows
        if now < np.inf:
            self.sent.update((int(done[-1]),))
        energy = np.zeros(len(done))
        for k in range(self.hops):
            at = np.minimum(np.searchsorted(hop, done + k), len(hop) - 1)
            energy += np.where(hop[at] == done + k, value[at], 0.0)
        return pd.DataFrame({"hop": done, "energy": energy}), rows[rows["hop"] > done[-1]]


def live_loudness(samples: DataFrame, *, by: str = "match_id", rate: float, hop: str = "500 milliseconds", hops: int = 2,
                  ends: DataFrame | None = None, delay: str = "5 seconds", idle: str = "3 hours") -> DataFrame:
    """RMS per sliding window of `hops` hops; missing samples count as silence. `x` is the sample, `rate` samples per second."""
    step = _millis(hop)
    rows = samples.select(by, "ts", F.floor(F.unix_millis("ts") / step).cast("long").alias("hop"), (F.col("x") * F.col("x")).alias("energy"))
    out = _per_match(rows, ends, by, delay, LoudnessRows(step, hops, _millis(idle)), LoudnessRows.out)
    return out.select(*keys_of(by), F.timestamp_millis(F.col("hop") * step).alias("from_ts"), F.sqrt(F.col("energy") / (rate * step * hops / 1000)).alias("rms"))
