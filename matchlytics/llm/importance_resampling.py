"""Resampling of documents towards a target text, by importance weights over hashed n-grams.

Features are runs of one and two words. A bucket's gain is the log ratio of its smoothed shares in the target and in
the documents, in thousandths; a document's weight is the floored mean gain of its features, its score the weight plus Gumbel noise from a keyed
digest of its id, and the highest scores are drawn: a sample without replacement by importance that any rerun repeats.

Tasks work on pieces of about 1 MB of text in numpy. A piece is one byte array in which words are parted by one space, so every
n-gram is a stretch of it. An open-addressed table interns the stretches of a piece: slots are found by the xxhash64 of the bytes and
linear probing, a slot is taken for an n-gram only after its bytes were compared, and per slot the table stores the bucket (CRC-32, worked out once
per distinct n-gram) and the count. The first pass adds the counts of all slots up by bucket, 10,000 numbers per
task. In the second, the gains are gathered by the slot ids of the occurrences and summed per document. The driver sees one number per bucket
and side. Ranks are given per stretch of scores, with one count per stretch in front, so no task sorts all documents.

Null and empty texts have no words: no features, weight 0. Very long texts are cut into pieces between words; the last word of a piece is
carried into the next, so that no pair of words is lost. Ties go to the smaller doc_id, null ids last, then to fewer features. Repeated
rows are documents of their own with equal scores. An empty table gives an empty result; an empty target has no counts. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_position
from .common import kept_table

BUCKETS = 10_000
PIECE = 1 << 20
#: N-grams up to this length are hashed side by side in numpy, longer ones by the library: the same function.
SHORT = 31

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[0:0x30] = _IS_WORD[0x3A:0x41] = _IS_WORD[0x5B:0x61] = _IS_WORD[0x7B:0x80] = False
# The primes of xxhash64 and the polynomial of CRC-32.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_POLYNOMIAL = np.uint32(0xEDB88320)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ _POLYNOMIAL, t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


class Words:
    """Words of some texts as stretches of one byte array."""

    def __init__(self, texts: list[bytes], carried: bool = False):
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        word = _IS_WORD[raw]
        before = np.concatenate(([False], word[:-1]))
        keep = word | before
        self.doc = (np.searchsorted(offsets, np.flatnonzero(word & ~before), side="right") - 1).astype(np.int64)
        kept = word[keep]
        self.bytes = np.concatenate((np.where(kept, _LOWER[raw[keep]], np.uint8(32)), np.zeros(8, dtype=np.uint8)))
        ends = np.flatnonzero(~kept)
        starts = np.concatenate(([0], ends[:-1] + 1)) if ends.size else ends
        pairs = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        own = slice(1 if carried else 0, None)  # a word carried from the piece before was counted there
        self.starts = np.concatenate((starts[own], starts[pairs]))
        self.lengths = np.concatenate((ends[own], ends[pairs + 1])) - self.starts
        self.docs = np.concatenate((self.doc[own], self.doc[pairs]))
        self.singles = len(starts[own])
        self.last = self.bytes[starts[-1] : ends[-1]].tobytes() if ends.size else b""
        self.n_docs = len(texts)

    def lanes(self) -> np.ndarray:
        """The eight bytes from every position on, as one number."""
        return np.lib.stride_tricks.as_strided(self.bytes.view(np.uint8)[: len(self.bytes) - len(self.bytes) % 8].view("<u8"),
                                               shape=(len(self.bytes) - 7,), strides=(1,))

    def stretch(self, i: int) -> bytes:
        a = self.starts[i]
        return self.bytes[a : a + self.lengths[i]].tobytes()

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums per document of one integer per occurrence."""
        out = np.zeros(self.n_docs, dtype=np.int64)
        for part in (slice(0, self.singles), slice(self.singles, None)):  # documents come in order in each
            sums = np.concatenate(([0], np.cumsum(values[part], dtype=np.int64)))
            out += np.diff(sums[np.searchsorted(self.docs[part], np.arange(self.n_docs + 1))])
        return out


def _by_length(lengths: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of the occurrences `of` with equal length."""
    order = of[np.argsort(lengths[of], kind="stable")]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if group.size:
            yield int(lengths[group[0]]), group


def hashes(w: Words) -> np.ndarray:
    """xxhash64 of all stretches."""
    out, lanes = np.empty(len(w.starts), dtype=np.uint64), w.lanes()
    short = w.lengths <= SHORT
    for n, group in _by_length(w.lengths, np.flatnonzero(short)):
        at, h = w.starts[group], np.full(len(group), _P5 + np.uint64(n), dtype=np.uint64)
        done = 0
        while n - done >= 8:
            h ^= _turned(lanes[at + done] * _P2, 31) * _P1
            h = _turned(h, 27) * _P1 + _P4
            done += 8
        if n - done >= 4:
            h ^= (lanes[at + done] & np.uint64(0xFFFFFFFF)) * _P1
            h = _turned(h, 23) * _P2 + _P3
            done += 4
        for k in range(done, n):
            h ^= w.bytes[at + k].astype(np.uint64) * _P5
            h = _turned(h, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        out[group] = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(w.stretch(i))
    return out


def checksums(w: Words, of: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches `of`."""
    out = np.empty(len(w.starts), dtype=np.uint32)
    short = w.lengths[of] <= SHORT
    for n, group in _by_length(w.lengths, of[short]):
        at, c = w.starts[group], np.full(len(group), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            c = _CRC[(c ^ w.bytes[at + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        out[group] = ~c
    for i in of[~short]:
        out[i] = zlib.crc32(w.stretch(i))
    return out[of]


class Table:
    """Open-addressed table of the distinct stretches of a piece: `slots` per occurrence, `bucket` and `count` per slot."""

    def __init__(self, w: Words, buckets: int = BUCKETS, hashed: np.ndarray | None = None):
        n = len(w.starts)
        key = hashes(w) if hashed is None else hashed
        size = 1 << max(4, int(2 * n).bit_length())
        mask = np.uint64(size - 1)
        owner = np.full(size, -1, dtype=np.int64)
        self.slots = np.empty(n, dtype=np.int64)
        lanes, left, slot = w.lanes(), np.arange(n), (key & mask).astype(np.int64)
        while left.size:
            free = owner[slot] < 0
            owner[slot[free]] = left[free]  # of several new stretches in one slot, the last one stays
            held = owner[slot]
            same = self._equal(w, lanes, key, held, left)
            self.slots[left[same]] = slot[same]
            left, slot = left[~same], (slot[~same] + 1) & int(mask)
        used = np.flatnonzero(owner >= 0)
        self.used = used
        self.bucket = np.zeros(size, dtype=np.int64)
        self.bucket[used] = checksums(w, owner[used]).astype(np.int64) % buckets
        self.count = np.bincount(self.slots, minlength=size)

    @staticmethod
    def _equal(w, lanes, key, a, b) -> np.ndarray:
        """Whether stretches a and b are the same bytes, place by place."""
        same = (key[a] == key[b]) & (w.lengths[a] == w.lengths[b])
        check = np.flatnonzero(same & (a != b))
        long = w.lengths[a[check]] > 64
        for i in check[long]:
            same[i] = w.stretch(a[i]) == w.stretch(b[i])
        check, done = check[~long], 0
        while check.size:
            left = np.minimum(w.lengths[a[check]] - done, 8)
            differ = (lanes[w.starts[a[check]] + done] ^ lanes[w.starts[b[check]] + done]) << (np.uint64(8) * (8 - left).astype(np.uint64))
            same[check[differ != 0]] = False
            done += 8
            check = check[(differ == 0) & (w.lengths[a[check]] > done)]
        return same

    def by_bucket(self, buckets: int = BUCKETS) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        np.add.at(out, self.bucket[self.used], self.count[self.used])
        return out


def pieces(texts: list[bytes | None], size: int = PIECE) -> Iterator[tuple[list[int], Words]]:
    """Words of the texts, whole ones put together up to `size` bytes, longer ones cut between words."""
    nos, group, total = [], [], 0
    for no, text in enumerate(texts):
        text = text or b""
        if len(text) > size:
            data, at, carry = np.frombuffer(text, dtype=np.uint8), 0, None
            while at < len(text):
                end = min(len(text), at + size)
                while end < len(text) and _IS_WORD[data[end - 1]]:  # on to the end of the word, a stretch at a time
                    stop = np.flatnonzero(~_IS_WORD[data[end : end + size]])
                    end = min(len(text), end + (int(stop[0]) + 1 if stop.size else size))
                part = text[at:end]
                w = Words([part if carry is None else carry + b" " + part], carry is not None)
                yield [no], w
                carry, at = w.last or carry, end
            continue
        nos.append(no)
        group.append(text)
        total += len(text)
        if total >= size:
            yield nos, Words(group)
            nos, group, total = [], [], 0
    if nos:
        yield nos, Words(group)


def bucket_counts(texts: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts."""
    def count(frames):
        total = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for _, w in pieces(list(frame["t"])):
                total += Table(w, buckets).by_bucket(buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.select(F.col(text).cast("binary").alias("t")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[bucket] = n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, in floored thousandths."""
    n = len(raw)
    ratio = ((target + 1.0) * (raw.sum() + float(n))) / ((raw + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of all documents."""
    def weigh(frames):
        for frame in frames:
            total, words, features = (np.zeros(len(frame), dtype=np.int64) for _ in range(3))
            for nos, w in pieces(list(frame["t"])):
                table = Table(w, len(gain))
                total[nos] += w.per_doc(gain[table.bucket][table.slots])
                words[nos] += np.bincount(w.docs[: w.singles], minlength=w.n_docs)
                features[nos] += np.bincount(w.docs, minlength=w.n_docs)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": words, "n_features": features, "weight": total // np.maximum(features, 1)})

    # as a string: pandas would turn ids beside nulls into doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    done = rows.mapInPandas(weigh, "doc_id string, n_words long, n_features long, weight long")
    return done.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, stretch: int = 16) -> DataFrame:
    """Weight, score and rank of all documents; the `percent` of those with `least_words` that score highest have a rank."""
    gain = gains(bucket_counts(target, buckets=buckets), bucket_counts(docs, buckets=buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = kept_table(weighed(docs, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "weights")
    open_ = rows.filter(F.col("n_words") >= least_words).withColumn("_all", F.lit(0))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranked = with_position(open_, "_all", order, bucket=F.floor(-F.col("score") / stretch).cast("long"), name="_pos", total="_n").drop("_all")
    drawn = F.col("_pos") < F.floor(F.lit(percent) * F.col("_n") / 100)
    ranked = ranked.withColumn("rank", F.when(drawn, F.col("_pos") + 1).cast("long")).drop("_pos", "_n")
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
