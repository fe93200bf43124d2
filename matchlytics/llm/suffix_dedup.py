"""Exact removal of repeated passages: suffix arrays per shard, common prefixes, merging across shards.

Every window of `SPAN` bytes that starts at two places of the corpus is repeated; the bytes it covers go. A window has an
anchor, the least hash of the 32-byte strings in it, at the same offset wherever the window stands. So a text is cut into
slices: runs of window starts with one anchor, with the bytes of their windows. Windows can only be equal in slices with
equal anchors. Anchors seen once are out at once; equal slices are counted together (their windows are repeated
by that alone). Where an anchor has slices that stand alone, its slices go to shards of about a megabyte:

* the suffix array of a shard comes from Larsson-Sadakane refinement: sorted by 5 bytes, then by 10, 20, 40, ...,
  each time only the groups that are still undecided, as packed numbers in numpy;
* Kasai's pass gives the common prefixes of neighbours, all slices in step, 8 bytes at a time; a run of neighbours that
  share `SPAN` bytes is one window text, repeated if it stands in the corpus more than once;
* an anchor with many slices is split over shards; windows that look unique there are sorted by digest and
  looked up in those of the other shards by binary search.

Texts are read twice, once for the anchors and once for the slices and results that are needed; what is shuffled are
anchors (one per 85 bytes), the slices in question, and texts with repeated parts.

Null text is empty. Texts shorter than the window keep everything. Copies of a text, repeated rows included, are
repeated in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table

SPAN, GRAM = 200, 32
#: Bytes of texts worked on together, bytes of a shard, slices of an anchor per shard.
CHUNK, SHARD, SPLIT = 1 << 20, 1 << 20, 2_000
BYTE_STEPS = np.array([1 << (8 * i) for i in range(1, 8)], dtype=np.uint64)
ANCHORS = "anchor long, slice long, k1 long, k2 long, lo int, len int"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    h, factor, step = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    return mixed(h)


def anchored(data: np.ndarray, ends: np.ndarray):
    """(anchor hash, first start, last start) of the slices of texts that lie one after the other and end at `ends`."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none
    hashes = gram_hashes(data)
    # the hash's upper 40 bits and the place: the least is the leftmost of the least
    low = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    step, width = 1, SPAN - GRAM + 1
    while 2 * step <= width:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    begins = np.r_[0, ends[:-1]]
    valid = np.zeros(len(place) + 1, dtype=np.int8)
    long = ends - begins >= SPAN
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - SPAN + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    new = np.r_[True, (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)] if len(starts) else none.astype(bool)
    first = starts[new]
    last = starts[np.r_[new[1:], True]] if len(starts) else none
    return hashes[place[first]], first, last


def _anchor_rows(frames):
    """Function for mapInPandas: (text, k1, k2) to the slices of the texts. A task sends one of the copies it reads."""
    seen: set[tuple[int, int]] = set()

    def rows(part):
        raw = b"".join(r[0] for r in part)
        ends = np.cumsum([len(r[0]) for r in part])
        anchor, first, last = anchored(np.frombuffer(raw, dtype=np.uint8), ends)
        which = np.searchsorted(ends, first, side="right")
        begin = np.r_[0, ends[:-1]][which]
        digest = np.array([xxhash.xxh3_64_intdigest(raw[a : b + SPAN]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
        k1, k2, base = (np.array([r[i] for r in part], dtype=np.int64)[which] for i in (1, 2, 3))
        return pd.DataFrame({"anchor": anchor.view(np.int64), "slice": digest.view(np.int64), "k1": k1, "k2": k2,
                             "lo": (first - begin + base).astype(np.int32), "len": (last - first + SPAN).astype(np.int32)})

    part, size = [], 0
    for frame in frames:
        for text, k1, k2 in zip(frame["text"], frame["k1"], frame["k2"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < SPAN or (k1, k2) in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add((k1, k2))
            for base in range(0, len(data) - SPAN + 1, CHUNK):  # long texts in stretches that share a window less a byte
                part.append((data[base : base + CHUNK + SPAN - 1], k1, k2, base))
                size += len(part[-1][0])
                if size > CHUNK:
                    yield rows(part)
                    part, size = [], 0
    if part:
        yield rows(part)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, for up to 2^20 bytes.

    `rank` holds the first place of a suffix's group. Each round orders the groups of several suffixes by the ranks
    `depth` bytes further on; group, rank and suffix are packed into one number, so that numpy sorts plain integers.
    """
    n = len(data)
    wide = np.r_[data, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    key = sum(wide[i : i + n] << np.uint64(8 * (4 - i)) for i in range(5))
    packed = np.sort((key << np.uint64(20)) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.r_[True, (packed[1:] >> np.uint64(20)) != (packed[:-1] >> np.uint64(20))]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group + 1  # 0 stands for the end of the data
    depth = 5
    while depth < n:
        open_ = np.flatnonzero(~new | ~np.r_[new[1:], True])  # slots of groups of several suffixes
        if not len(open_):
            break
        at = order[open_]
        ahead = rank[np.minimum(at + depth, n)]
        # slots of a group follow one another and stay its own: the group is the upper part of the key
        number = np.cumsum(new[open_]) - 1
        packed = np.sort((number.astype(np.uint64) << np.uint64(42)) | (ahead.astype(np.uint64) << np.uint64(21)) | at.astype(np.uint64))
        order[open_] = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
        upper = packed >> np.uint64(21)
        new[open_] = np.r_[True, upper[1:] != upper[:-1]]
        group = np.maximum.accumulate(np.where(new[open_], open_, 0))
        rank[order[open_]] = group + 1
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For window starts `order` (sorted suffixes): bytes shared with the one before, up to SPAN.

    Kasai: from a start to the next in its slice the shared length falls by one at most, as long as the neighbour's
    next byte is a window start too. Slices (`start`, `count` window starts) go in step.
    """
    n = len(data)
    wide = np.r_[data, np.zeros(16, dtype=np.uint8)].astype(np.uint64)
    words = sum(wide[i : i + n + 8] << np.uint64(8 * (7 - i)) for i in range(8))
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    owned = np.zeros(n + 1, dtype=bool)
    owned[order] = True
    shared = np.zeros(n, dtype=np.int64)
    lanes = np.argsort(-count, kind="stable")
    start, count = start[lanes], count[lanes]
    h = np.zeros(len(start), dtype=np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        m = int(np.searchsorted(-count, -t, side="left"))
        p = start[:m] + t
        q = before[p]
        carry = h[:m]
        if t:
            kept = (before[p - 1] >= 0) & owned[before[p - 1] + 1]
            carry = np.where(kept, np.maximum(carry - 1, 0), 0)
        live = np.flatnonzero((q >= 0) & (carry < SPAN))
        carry = np.where(q >= 0, carry, 0)
        while len(live):
            at = carry[live]
            differ = words[np.minimum(p[live] + at, n)] ^ words[np.minimum(q[live] + at, n)]
            equal = np.where(differ == 0, 8, 7 - np.searchsorted(BYTE_STEPS, differ, side="right"))  # bytes before the first that differs
            carry[live] = np.minimum(at + equal, SPAN)
            live = live[(differ == 0) & (at + 8 < SPAN)]
        h[:m] = carry
        shared[p] = carry
    return shared[order]


def repeated_starts(slices: list[bytes], weights: np.ndarray):
    """Which window starts of each slice are repeated, and one place of each window text: slice, start, digest.

    A slice of weight w stands for w places of the corpus.
    """
    data = np.frombuffer(b"".join(slices), dtype=np.uint8)
    sizes = np.array([len(s) for s in slices], dtype=np.int64)
    start, count = np.r_[0, np.cumsum(sizes)[:-1]], sizes - SPAN + 1
    owner = np.repeat(np.arange(len(slices)), sizes)
    order = suffix_array(data)
    order = order[order - start[owner[order]] < count[owner[order]]]  # window starts alone
    shared = common_prefixes(data, order, start, count)
    run = np.cumsum(np.r_[True, shared[1:] < SPAN]) - 1
    heavy = np.bincount(run, weights=weights[owner[order]]) >= 2
    flags = np.zeros(len(data), dtype=bool)
    flags[order[heavy[run]]] = True
    first = order[np.r_[True, run[1:] != run[:-1]]]
    return [flags[a : a + c] for a, c in zip(start.tolist(), count.tolist(), strict=True)], owner[first], first - start[owner[first]]


def _shards(frames):
    """Function for mapInPandas: slices sorted by (anchor, sub) to their repeated starts, shard by shard.

    Slices of anchors that are split over shards also bring the window texts of the shard, to be looked up in the others.
    """
    held, size, group, key = [], 0, [], None

    def solve(rows):
        if not rows:
            return None
        flags, who, at = repeated_starts([r[3] for r in rows], np.array([r[4] for r in rows], dtype=np.float64))
        texts: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
        for k, t in zip(who.tolist(), at.tolist(), strict=True):
            if rows[k][5] > 1:
                digest = xxhash.xxh3_64_intdigest(rows[k][3][t : t + SPAN]) - (1 << 63)
                places, digests = texts.setdefault(k, {}).setdefault(digest % rows[k][5], ([], []))
                places.append(t)
                digests.append(digest)
        parts = [[{"part": p, "at": x, "digest": d} for p, (x, d) in texts.get(k, {}).items()] for k in range(len(rows))]
        out = [(r[0], r[1], r[2], len(f), np.packbits(f).tobytes() if f.any() else None, p, r[5]) for r, f, p in zip(rows, flags, parts, strict=True)]
        return pd.DataFrame(out, columns=["anchor", "slice", "sub", "n", "flags", "parts", "subs"])

    for frame in frames:
        for r in zip(*(frame[c] for c in ("anchor", "slice", "sub", "bytes", "w", "subs")), strict=True):
            if (r[0], r[2]) != key:
                more = sum(len(x[3]) for x in group)
                if held and size + more > SHARD:
                    yield solve(held)
                    held, size = [], 0
                held += group
                size += more
                group, key = [], (r[0], r[2])
            group.append(r)
    if held and size + sum(len(x[3]) for x in group) > SHARD:
        yield solve(held)
        held = []
    if held or group:
        yield solve(held + group)


FLAGS = "anchor long, slice long, sub int, n int, flags binary, parts array<struct<part:int,at:array<int>,digest:array<bigint>>>, subs int"


def _cutter(frames):
    """Function for mapInPandas: texts with their lists of slices to the bytes of the slices."""
    for frame in frames:
        rows = []
        for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(x["anchor"], x["slice"], x["sub"], x["subs"], x["w"], data[x["lo"] : x["lo"] + x["len"]]) for x in wanted]
        yield pd.DataFrame(rows, columns=["anchor", "slice", "sub", "subs", "w", "bytes"])


def across_shards(rows: pd.DataFrame) -> pd.DataFrame:
    """Window texts of one anchor that other shards have too: each shard's sorted digests are searched in the others'."""
    times = rows["at"].map(len).to_numpy()
    rows = pd.DataFrame({c: np.repeat(rows[c].to_numpy(), times) for c in ("anchor", "slice", "sub")} | {c: np.concatenate(list(rows[c])) for c in ("at", "digest")})
    parts = {sub: np.sort(part["digest"].to_numpy()) for sub, part in rows.groupby("sub")}
    found = np.zeros(len(rows), dtype=bool)
    sub, digest = rows["sub"].to_numpy(), rows["digest"].to_numpy()
    for other, known in parts.items():
        at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
        found |= (known[at] == digest) & (sub != other)
    return rows.loc[found, ["anchor", "slice", "at"]]


def _covered(data_size: int, ranges) -> list[tuple[int, int]]:
    """Maximal runs covered by the windows of (lo, n, flags, at): all n starts, the flagged ones, or those in `at`."""
    starts = []
    for r in ranges:
        if r["at"] is not None:
            starts.append(r["lo"] + np.asarray(r["at"], dtype=np.int64))
        elif r["flags"] is None:
            starts.append(r["lo"] + np.arange(r["n"], dtype=np.int64))
        else:
            starts.append(r["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["flags"], dtype=np.uint8))[: r["n"]]))
    edge = np.zeros(data_size + 1, dtype=np.int64)
    p = np.unique(np.concatenate(starts)) if starts else np.zeros(0, dtype=np.int64)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + SPAN, -1)
    step = np.diff(np.r_[0, (np.cumsum(edge) > 0).astype(np.int8)])
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def removed(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, ranges, strict=True):
        data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
        spans = _covered(len(data), found)
        for a, b in spans:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        rows.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "spans"])


def text_keys(text: Column) -> list[Column]:
    """128 bits of hash of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


KEYS = ["k1", "k2"]


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, text) of the distinct texts whose keys `wanted` may hold.

    Its keys are broadcast as numbers below 2^20, at most so many rows; other texts are not shuffled.
    """
    bucket = lambda: F.pmod("k1", F.lit(1 << 20)).cast("int")
    some = wanted.select(bucket().alias("_b")).distinct()
    return docs.withColumn("_a", bucket()).join(F.broadcast(some), F.col("_a") == F.col("_b"), "left_semi").groupBy(*KEYS).agg(F.first("text").alias("text"))


def repeated_parts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, spans) of the distinct texts with repeated parts, copies apart."""
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") >= SPAN)
    docs = docs.select("text", *text_keys(F.col("text")))
    rows = kept_table(docs.mapInPandas(_anchor_rows, ANCHORS), "anchors")
    # anchors are counted with a map-side combine and joined back: the rows of a very common one are split like any skewed join
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    live = kept_table(rows.join(often, "anchor"), "live-anchors")
    slices = live.groupBy("anchor", "slice").agg(F.count(F.lit(1)).cast("int").alias("w"), *[F.first(c).alias(c) for c in (*KEYS, "lo", "len")])
    slices = kept_table(slices, "slices")
    anchors = slices.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("w") == 1, 1)).alias("alone"))
    subs = F.ceil(F.col("c") / SPLIT).cast("int").alias("subs")
    slices = slices.join(anchors.select("anchor", "alone", subs), "anchor")
    none = F.lit(None)
    whole = slices.filter("alone = 0").select("anchor", "slice", (F.col("len") - SPAN + 1).alias("n"), none.cast("binary").alias("flags"), none.cast("array<int>").alias("at"))
    part = slices.filter("alone > 0").withColumn("sub", F.pmod(F.xxhash64("slice"), F.col("subs")).cast("int"))
    wanted = kept_table(part.groupBy(*KEYS).agg(F.collect_list(F.struct("anchor", "slice", "sub", "subs", "w", "lo", "len")).alias("wanted")), "wanted-slices")
    cut = texts_of(docs, wanted).join(wanted, KEYS).select("text", "wanted").mapInPandas(_cutter, "anchor long, slice long, sub int, subs int, w int, bytes binary")
    shards = kept_table(cut.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub").mapInPandas(_shards, FLAGS), "shards")
    flagged = shards.filter("flags is not null").select("anchor", "slice", "n", "flags", none.cast("array<int>").alias("at"))
    # one row for the window texts of a slice that go to one part, not one for each
    loose = shards.filter("subs > 1").select("anchor", "slice", "sub", F.explode("parts").alias("x")).select("anchor", "slice", "sub", "x.part", "x.at", "x.digest")
    loose = loose.groupBy("anchor", "part").applyInPandas(across_shards, "anchor long, slice long, at int")
    crossed = loose.groupBy("anchor", "slice").agg(F.collect_list("at").alias("at")).select("anchor", "slice", F.size("at").alias("n"), none.cast("binary").alias("flags"), "at")
    marks = whole.unionByName(flagged).unionByName(crossed)
    places = live.select("anchor", "slice", *KEYS, "lo").join(marks, ["anchor", "slice"])
    ranges = kept_table(places.groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "n", "flags", "at")).alias("ranges")), "repeated-ranges")
    made = F.pandas_udf(removed, "n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>")
    return texts_of(docs, ranges).join(ranges, KEYS).select(*KEYS, made("text", "ranges").alias("r")).select(*KEYS, "r.*")


def without_repeats(docs: DataFrame, *, keep=("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte ranges) of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("_sha"), *text_keys(t))
    copies = rows.filter(F.col("n_bytes") >= SPAN).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    parts = repeated_parts(docs, text=text).join(copies, KEYS, "full_outer")
    parts = parts.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("_c").isNotNull().alias("_all"), "n_removed", "n_spans", "kept_sha256", "spans")
    out = rows.join(parts, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").withColumn("_all", F.coalesce("_all", F.lit(False)))
    pick = lambda whole, some, none: F.when(F.col("_all"), whole).otherwise(F.coalesce(F.col(some), none)).alias(some)
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")), pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
                      pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("_sha")), pick(span, "spans", F.array().cast("array<struct<start: int, end: int>>")))
