"""Near duplicates: exact Jaccard join on 5-word shingles by size-banded tiles with bitmap signatures.

A document's set holds 64-bit hashes of its shingles. In one order of all shingles (frequent ones last, else by hash)
two sets with a similarity of 75 % share one of the first n - ceil(0.75 n) + 1 of either, so sets meet in tiles: one per
such shingle, or per several that just the same sets have, sorted by size, where a set is compared with those up to 4/3
of its size. A pair of a tile is bounded from above before anything exact is done: with bitmaps of the parities of the
hashes, |A and B| <= (|A| + |B| - bits that differ) / 2. A bitmap has some two bits for each hash of its set, as a full
one bounds nothing. A pair must also come from the tiles of as many shingles as its sizes ask for (see _shared_needed).
What these bounds leave is decided by intersecting the sorted arrays of hashes.

Groups of thousands of near copies would give millions of such pairs. So it goes in two rounds. In the first, each set of a tile
nominates only the most similar smaller and the most similar larger one, so that a copy finds its original on either side; exact links
give components. In the second, tiles whose sets are all
in one component are done, and in the others all remaining pairs of different components are decided. Pairs that are
never looked at lie in one component already, so the components are those of all links.

Equal sets stand for one another: a task sends one of the copies it reads to the tiles. A tile with more than `TILE` sets is
cut into chunks that meet in pairs, in tasks of their own. Frequent shingles are those of a bounded sample of texts; the
sample sets the order and so the work, never the result.

Null and empty texts have empty sets and are linked with nothing; a text with fewer words than a shingle is one
shingle; repeated rows are copies like any others; a null doc_id never becomes the id of a component with another.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, small_batches, whole_row
from .components import components

WIDTH = 5
#: Similarity from which two sets are linked: 100 * intersection >= SHARE * union.
SHARE = 75
#: Bits of the smallest and of the largest bitmap; the width follows the size of the set.
BITS, MOST_BITS = 512, 8192
#: Texts sampled for frequent shingles, and how many of them must hold one.
SAMPLE, FREQUENT = 20_000, 8
TILE = 20_000
#: Pairs of tiles that are held before they are sent on.
PAIRS = 1 << 19
#: Bytes of texts that are hashed at a time; a worker takes some 100 bytes of memory for each.
CHUNK = 1 << 18

SETS = "rid long, doc_id long, sum binary, sid binary, n int, bits binary, prefix array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _factors():
    """Random numbers of the bytes and factors of the places of a shingle."""
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64), rng.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int):
    """At least n powers of an odd number and of its inverse mod 2^64; grown when a longer text comes."""
    if not _POWERS or len(_POWERS[0]) < n:
        odd, n = 0x9E3779B97F4A7C15, max(n, CHUNK + CHUNK // 2)
        up, down = np.full(n, odd, dtype=np.uint64), np.full(n, pow(odd, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of lower-cased UTF-8 bytes."""
    table, (up, down) = _factors()[0], _powers(len(data) + 1)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[np.uint64(0), np.cumsum(table[data] * up[: len(data)])]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0

    def flush():
        raw = np.frombuffer(b" ".join(part), dtype=np.uint8)
        data = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        words, start = word_hashes(data)
        first = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in part]))
        place = _factors()[1]
        whole = sum(words[j : len(words) - WIDTH + 1 + j] * place[j] for j in range(WIDTH)) if len(words) >= WIDTH else np.zeros(0, dtype=np.uint64)
        whole = mixed(whole)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WIDTH:
                out.append(np.unique(whole[a : b - WIDTH + 1]))
            elif b > a:
                short = (words[a:b] * place[: b - a]).sum(keepdims=True) + place[WIDTH:] * np.uint64(b - a)
                out.append(mixed(short))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        part.clear()

    for text in texts:
        part.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size > CHUNK:
            flush()
            size = 0
    if part:
        flush()
    return out


def parity_bits(hashes: np.ndarray) -> bytes:
    width = BITS
    while width < MOST_BITS and 2 * width < 3 * len(hashes):
        width *= 2
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def prefix_of(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(share * n) + 1 hashes of a set, frequent ones last."""
    n = len(hashes)
    if len(frequent) and n:
        at = np.searchsorted(frequent, hashes)
        late = frequent[np.minimum(at, len(frequent) - 1)] == hashes
        hashes = np.r_[hashes[~late], hashes[late]]
    return hashes[: n - -(-SHARE * n // 100) + 1]


def _measurer(frequent):
    def measure(frames):
        part, number, seen = TaskContext.get().partitionId() << 33, 0, set()
        hot = np.frombuffer(frequent.value, dtype=np.uint64)
        for frame in frames:
            rows = []
            for doc, total, hashes in zip(frame["doc_id"], frame["sum"], shingle_sets(frame["text"]), strict=True):
                sid = hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None
                first = sid is not None and sid not in seen
                if first and len(seen) < 1_000_000:
                    seen.add(sid)
                rows.append((part + number, doc, total, sid, len(hashes), parity_bits(hashes) if first else None, prefix_of(hashes, hot).view(np.int64) if first else None))
                number += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")]).astype({"doc_id": "Int64"})
    return measure


def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([h.view(np.int64) for h in shingle_sets(texts)])


def _members(most: int):
    """Function for mapInArrow over (sig, rid), sorted: the sets of each shingle that more than one has.

    More than `most` of them come in pieces, with the shingle as `own`.
    """
    import pyarrow as pa

    def grouped(batches):
        sig = rid = np.zeros(0, dtype=np.int64)
        begun = False  # pieces of the first shingle are out already
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                sig, rid = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((sig, "sig"), (rid, "rid")))
            if not len(sig):
                continue
            edge = np.r_[0, np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig)]
            start, end = edge[:-1], edge[1:]
            cut = end - start > most
            cut[0] |= begun
            done = ~cut & (end - start > 1)
            rest, begun = len(sig), False
            if batch is not None:  # the last shingle may go on in the next batch
                done[-1], rest, begun = False, start[-1], bool(cut[-1])
            parts = [np.c_[start[done], end[done], np.zeros(done.sum(), dtype=np.int64)]]
            for a, b in zip(start[cut], end[cut], strict=True):
                at = np.arange(a, b, most)
                to = np.minimum(at + most, b)
                if a == rest:  # its last piece waits
                    at, to, rest = at[:-1], to[:-1], at[-1]
                parts.append(np.c_[at, to, np.ones(len(at), dtype=np.int64)])
            a, b, own = np.concatenate(parts).T
            size = b - a
            place = np.r_[0, np.cumsum(size)]
            values = rid[np.repeat(a - place[:-1], size) + np.arange(place[-1])]
            members = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(sig[a]), pa.array(sig[a], mask=own == 0), members], names=["sig", "own", "members"])
            sig, rid = sig[rest:], rid[rest:]
    return grouped


def _needed(a, b):
    """Least intersection of sets of sizes a and b that are linked."""
    return -(-SHARE * (a + b) // (100 + SHARE))


def _shared_needed(a, b):
    """Least number of prefix shingles that linked sets of sizes a and b share.

    Let A's prefix end first in the order. Then a shingle of both is in both prefixes or behind A's prefix, so the
    intersection is at most the shared prefix shingles plus the size of A without its prefix, which is ceil(0.75 a) - 1.
    """
    return _needed(a, b) - (-(-SHARE * np.maximum(a, b) // 100) - 1)


class Bitmaps:
    """The bitmaps of some rows at every width up to their own: the parities of half a width are those of both halves together."""

    def __init__(self, bits):
        size = np.array([len(b) for b in bits], dtype=np.int64)
        self.words = size // 8
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows, data = np.zeros(0, dtype=np.int64), np.zeros((0, MOST_BITS // 32), dtype=np.uint64)
        width = MOST_BITS // 64
        while width >= BITS // 64:
            own = np.flatnonzero(self.words == width)
            fresh = np.frombuffer(b"".join(bits[i] for i in own), dtype=np.uint64).reshape(len(own), width)
            rows, data = np.r_[rows, own], np.concatenate([data[:, :width] ^ data[:, width:], fresh])
            place = np.zeros(len(size), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self.planes[width] = place, data
            width //= 2

    def differ(self, i, j):
        """Number of bits in which rows i and j differ, at the smaller width of the two."""
        width, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), dtype=np.int64)
        for w, (place, data) in self.planes.items():
            which = np.flatnonzero(width == w)
            for c in range(0, len(which), (1 << 20) // w):
                k = which[c : c + (1 << 20) // w]
                out[k] = np.bitwise_count(data[place[i[k]]] ^ data[place[j[k]]]).sum(1, dtype=np.int64)
        return out


def _bounds(bits: Bitmaps, rows, i, j, n):
    """Upper bound of the intersections of sets i and j, which are numbers into `rows`."""
    return (n[i] + n[j] - bits.differ(rows[i], rows[j])) // 2


def _tile_pairs(every: bool):
    """Function for mapInPandas over tiles, one (sig, lo, hi) behind the other, sorted by n: pairs that the bound leaves, with the number of shingles
    whose tiles gave them and the number of shared prefix shingles they need.

    Either all of them of different labels, or for each row those with the best bounds among the rows before and behind it.
    """
    def one_tile(rid, n, side, label, times, bits, rows):
        cross = side.min() != side.max()
        above, larger = np.full(len(rid), -1, dtype=np.int64), np.full(len(rid), -1, dtype=np.int64)
        for a in range(0, len(rid), 256):
            i = np.arange(a, min(len(rid), a + 256))
            best, mate = np.full(len(i), -1, dtype=np.int64), np.full(len(i), -1, dtype=np.int64)
            for b in range(0, i[-1] + 1, 2048):
                j = np.arange(b, min(i[-1], b + 2048))
                ok = (j[None, :] < i[:, None]) & (100 * n[j][None, :] >= SHARE * n[i][:, None])
                ok &= label[j][None, :] != label[i][:, None]
                if cross:
                    ok &= side[j][None, :] != side[i][:, None]
                x, y = np.nonzero(ok)
                for c in range(0, len(x), 1 << 17):
                    p, q = i[x[c : c + (1 << 17)]], j[y[c : c + (1 << 17)]]
                    bound = _bounds(bits, rows, p, q, n)
                    fine = bound >= _needed(n[p], n[q])
                    p, q, bound = p[fine], q[fine], bound[fine]
                    if every:
                        yield rid[p], rid[q], _shared_needed(n[p], n[q]), times[p]
                    elif len(p):
                        score = bound - _needed(n[p], n[q])
                        order = np.argsort(score, kind="stable")
                        k = p[order] - a
                        top = np.full(len(i), -1, dtype=np.int64)
                        top[k] = order  # the last, so best, of each row
                        has = np.flatnonzero(top >= 0)
                        has = has[score[top[has]] > best[has]]
                        best[has], mate[has] = score[top[has]], q[top[has]]
                        first = int(q.min())
                        top = np.full(int(q.max()) - first + 1, -1, dtype=np.int64)
                        top[q[order] - first] = order
                        has = np.flatnonzero(top >= 0)
                        has = has[score[top[has]] > above[has + first]]
                        above[has + first], larger[has + first] = score[top[has]], p[top[has]]
            if not every:
                has = np.flatnonzero(mate >= 0)
                yield rid[i[has]], rid[mate[has]], _shared_needed(n[i[has]], n[mate[has]]), times[i[has]]
        if not every:
            i = np.flatnonzero(larger >= 0)
            yield rid[i], rid[larger[i]], _shared_needed(n[i], n[larger[i]]), times[i]

    def small_tiles(group, rid, n, label, times, bits, rows, longest):
        """All tiles of up to `longest` rows at once, by the distance of the two rows."""
        best, mate, above, larger = (np.full(len(rid), -1, dtype=np.int64) for _ in range(4))
        for d in range(1, longest):
            i = np.flatnonzero((group[d:] == group[:-d]) & (label[d:] != label[:-d]) & (100 * n[:-d] >= SHARE * n[d:])) + d
            if not len(i):
                continue
            bound, least = _bounds(bits, rows, i, i - d, n), _needed(n[i], n[i - d])
            fine = bound >= least
            i, score = i[fine], (bound - least)[fine]
            if every:
                yield rid[i], rid[i - d], _shared_needed(n[i], n[i - d]), times[i]
            else:
                up = score > best[i]
                best[i[up]], mate[i[up]] = score[up], i[up] - d
                up = score > above[i - d]
                above[i[up] - d], larger[i[up] - d] = score[up], i[up]
        if not every:
            for chosen in (mate, larger):
                i = np.flatnonzero(chosen >= 0)
                yield rid[i], rid[chosen[i]], _shared_needed(n[i], n[chosen[i]]), times[i]

    def work(frame):
        key = frame[["sig", "lo", "hi"]].to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]).any(1)]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(group)])
        rid, n, side, label, times = (frame[c].to_numpy() for c in ("rid", "n", "side", "label", "times"))
        bits = Bitmaps(frame["bits"].to_numpy())
        cut = key[:, 1] != key[:, 2]
        small = (sizes[group] <= 48) & ~cut
        if small.any():
            k = np.flatnonzero(small)
            yield from small_tiles(group[k], rid[k], n[k], label[k], times[k], bits, k, int(sizes[group[k]].max()))
        for g in np.flatnonzero((sizes > 48) | cut[starts]):
            k = np.arange(starts[g], starts[g] + sizes[g])
            yield from one_tile(rid[k], n[k], side[k], label[k], times[k], bits, k)

    def pairs(frames):
        held: list[pd.DataFrame] = []
        rows = 0

        def counted(found):
            a, b, need, times = (np.concatenate([f[x] for f in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for x in range(4))
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else order
            return pd.DataFrame({"a": low[first], "b": high[first], "times": np.add.reduceat(times[order], first) if len(low) else times, "need": need[order[first]]})

        def out(frame):
            found, size = [], 0
            for part in work(frame):
                found.append(part)
                size += len(part[0])
                if size > PAIRS:  # a tile may leave very many pairs
                    yield counted(found)
                    found, size = [], 0
            yield counted(found)

        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            rows += len(frame)
            if rows < 20_000:
                continue
            frame = pd.concat(held, ignore_index=True)
            last = (frame[["sig", "lo", "hi"]] == frame[["sig", "lo", "hi"]].iloc[-1]).all(axis=1).to_numpy()
            whole = int(np.argmax(last))  # the last tile may go on in the next batch
            if whole:
                yield from out(frame.iloc[:whole])
            held, rows = [frame.iloc[whole:]], len(frame) - whole
        if held:
            yield from out(pd.concat(held, ignore_index=True))
    return pairs


def _exact(batches):
    """Pairs whose sorted arrays intersect in enough hashes; only the texts of some hundred pairs leave Arrow at a time."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            left, right = part.column("a").to_pylist(), part.column("b").to_pylist()
            texts = dict(zip(left, part.column("x").to_pylist(), strict=True)) | dict(zip(right, part.column("y").to_pylist(), strict=True))
            sets = dict(zip(texts, shingle_sets(texts.values()), strict=True))
            linked = []
            for a, b in zip(left, right, strict=True):
                small, large = sorted((sets[a], sets[b]), key=len)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * both >= SHARE * (len(small) + len(large) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in linked], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


class JaccardJoin:
    """Sets of `docs` and their components."""

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text"):
        self.spark = docs.sparkSession
        self.texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("sum"))
        frequent = self.spark.sparkContext.broadcast(self._frequent())
        with small_batches(self.spark, records=2048):
            self.sets = kept_table(self.texts.mapInPandas(_measurer(frequent), SETS), "shingle-sets")

    def _frequent(self) -> bytes:
        """Sorted hashes of shingles that many sampled texts share: SAMPLE * words / FREQUENT numbers at most."""
        step = max(1, self.texts.count() // SAMPLE)
        some = self.texts.filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).dropDuplicates(["sum"])
        rows = some.select(F.explode(F.pandas_udf(_shingles, "array<long>")("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
        return np.sort(np.array([r["h"] for r in rows.select("h").collect()], dtype=np.int64).view(np.uint64)).tobytes()

    def live(self) -> DataFrame:
        """(members, own, sig, times): the sets that have a prefix shingle together, once for all `times` shingles that just they have.

        Near copies have most shingles in common, so tiles, and the pairs they give, are far fewer than shingles. A shingle of
        more than TILE sets comes in pieces, with itself as `own`.
        """
        rows = self.sets.filter("prefix is not null").select("rid", F.explode("prefix").alias("sig")).repartition("sig").sortWithinPartitions("sig", "rid")
        groups = rows.mapInArrow(_members(TILE), "sig long, own long, members array<long>")
        return kept_table(groups.groupBy("members", "own").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times")), "live-shingles")

    def tiles(self, live: DataFrame) -> DataFrame:
        """Rows of the tiles: large shingle groups are cut into chunks, each pair of which is a tile.

        `place` and `part` bring the tiles of one least set together, some TILE rows at a time: near copies meet in many tiles, and
        a task counts a pair once for all the tiles it has at hand.
        """
        live = live.withColumn("place", F.coalesce("own", F.element_at("members", 1)))
        large = live.groupBy("place").agg(F.sum(F.size("members")).alias("_n")).filter(F.col("_n") > TILE)
        rows = live.join(large, "place", "left").withColumn("_p", F.coalesce(F.ceil(F.col("_n") / TILE), F.lit(1)).cast("long"))
        rows = rows.select("place", F.pmod(F.xxhash64("sig"), "_p").alias("part"), "sig", "times", F.when(F.col("own").isNull(), F.lit(1).cast("long")).otherwise(F.col("_p")).alias("_k"), F.explode("members").alias("rid"))
        rows = rows.withColumn("side", F.pmod(F.xxhash64("rid"), F.col("_k"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        return rows.select("place", "part", "sig", "times", "rid", "side", F.least("side", "_o").alias("lo"), F.greatest("side", "_o").alias("hi"))

    def candidates(self, live: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Distinct pairs that the bounds leave, of different labels where there are any."""
        numbers = self.sets.filter("prefix is not null").select("rid", "n", "bits")
        rows = self.tiles(live)
        if labels is None:
            rows = rows.withColumn("label", F.col("rid"))
        else:
            rows = rows.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        rows = rows.join(numbers, "rid").select("place", "part", "sig", "lo", "hi", "side", "rid", "n", "label", "times", "bits")
        rows = rows.repartition("place", "part", "lo", "hi").sortWithinPartitions("place", "part", "sig", "lo", "hi", "n", "rid").drop("place", "part")
        pairs = rows.mapInPandas(_tile_pairs(labels is not None), "a long, b long, times long, need long")
        pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.first("need").alias("need"))
        # all tiles of a pair give it in the second round, so there the count is exact; a nomination needs some support
        least = F.col("need") if labels is not None else F.floor(F.col("need") / 3)
        return pairs.filter(F.col("times") >= least).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked. Only texts that a pair needs are read again.

        To leave most other texts where they are, the digests needed are broadcast as numbers below 2^20, at most so
        many rows; a text outside them is not shuffled.
        """
        ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        need = kept_table(self.sets.select("rid", "doc_id", "sum").join(ids, "rid"), "needed-texts")
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("int")
        some = need.select(bucket("sum").alias("_b")).distinct()
        texts = self.texts.join(F.broadcast(some), bucket(self.texts["sum"]) == some["_b"], "left_semi")
        who = need.select("rid", F.col("sum").alias("_sum"), F.col("doc_id").alias("_doc"))
        found = texts.join(who, (F.col("sum") == F.col("_sum")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        # texts go to the pairs, not their sets: they take a quarter of the room when compressed
        found = found.groupBy("rid").agg(F.first("text").alias("text"))
        both = pairs.join(found.select(F.col("rid").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("rid").alias("b"), F.col("text").alias("y")), "b")
        with small_batches(self.spark):  # a row holds two whole texts
            return kept_table(both.mapInArrow(_exact, "a long, b long"), "exact-links")

    def labels(self) -> DataFrame:
        """(rid, label) of all sets that are linked with another."""
        live = self.live()
        first = kept_table(self.candidates(live, None), "nominated")
        linked = self.links(first)
        label = kept_table(components(linked).select(F.col("node").alias("rid"), F.col("component").alias("label")), "labels")
        mixed_tiles = live.select("sig", F.explode("members").alias("rid")).join(label, "rid", "left").withColumn("label", F.coalesce("label", "rid")).groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("sig")
        rest = kept_table(self.candidates(live.join(mixed_tiles, "sig"), label).join(first, ["a", "b"], "left_anti"), "remaining")
        more = self.links(rest)
        if more.isEmpty():
            return label
        return kept_table(components(linked.unionByName(more)).select(F.col("node").alias("rid"), F.col("component").alias("label")), "labels")

    def documents(self) -> DataFrame:
        """(rid, doc_id, sum, n_shingles, group, component_id) per document; `group` is null for an empty set."""
        label = self._groups()
        nodes = self.sets.filter("sid is not null").groupBy("sid").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("doc"))
        nodes = nodes.join(label, "rid", "left").withColumn("group", F.coalesce("label", "rid"))
        least = nodes.groupBy("group").agg(F.min("doc").alias("component_id"))
        nodes = nodes.select(F.col("sid").alias("_sid"), "group").join(least, "group")
        rows = self.sets.filter("sid is not null").join(nodes, F.col("sid") == F.col("_sid"))
        out = rows.select("rid", "doc_id", "sum", F.col("n").cast("long").alias("n_shingles"), "group", "component_id")
        empty = self.sets.filter("sid is null").select("rid", "doc_id", "sum", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
        return out.unionByName(empty)

    def _groups(self) -> DataFrame:
        """Labels of the least rid of each set: copies read by different tasks have rids of their own."""
        label = self.labels()
        node = self.sets.filter("prefix is not null").select("rid", "sid")
        least = node.groupBy("sid").agg(F.min("rid").alias("g"), F.count(F.lit(1)).alias("c"))
        tied = node.join(least.filter("c > 1"), "sid").select(F.col("rid"), F.col("g").alias("label")).filter("rid <> label")
        links = label.unionByName(tied).select(F.col("rid").alias("a"), F.col("label").alias("b"))
        if tied.isEmpty():
            return label
        return components(links).select(F.col("node").alias("rid"), F.col("component").alias("label"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id. Documents without words stay."""
    join = JaccardJoin(docs, key=key, text=text)
    groups = join.documents().filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid", "sum")).alias("r"))
    at = lambda doc, total: [total.alias("_sum"), F.coalesce(doc.cast("long"), F.lit(0).cast("long")).alias("_id"), doc.isNull().alias("_no")]
    chosen = groups.select(*at(F.col("r.doc_id"), F.col("r.sum")))
    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = docs.filter(~wordless).select(whole_row(docs).alias("_doc"), *at(F.col(key), F.unhex(F.md5(F.col(text)))))
    # joined and told apart by the same plain columns, so whole rows are shuffled once
    kept = rows.join(chosen, ["_sum", "_id", "_no"]).dropDuplicates(["_sum", "_id", "_no"]).select("_doc.*")
    return kept.unionByName(docs.filter(wordless))
