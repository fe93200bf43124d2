"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from matchlytics.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in rows for f in features(x)[1]) for rows in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + float(buckets)) / ((s[b] + 1) * (big_t + float(buckets)))))
    out = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = [(r, i + 1 if i < percent * len(open_) // 100 else None) for i, r in enumerate(open_)]
    rank += [(r, None) for r in out if r[1] < least]
    return collections.Counter((r[0], r[2], r[3], r[4], k) for r, k in rank)


def words(rng, n):
    return rng.choice([" ", "  ", ", ", "\n", "-"]).join("".join(rng.choice("abcDEé9ß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [words(rng, rng.randint(0, 90)) for _ in range(120)]
    long = words(rng, 30_000)
    return out + ["", None, " .,", "x" * 200 + " " + "y" * 100 + " " + "x" * 200, out[3], long, "ж" * 5000 + " " + words(rng, 40), "one"]


def test_resampling_against_plain_python(spark, texts, monkeypatch):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, texts[3]), (2**62 + 1, texts[9])]
    target = [texts[1], texts[2] + " unseen words", None, "", words(random.Random(1), 500)]
    docs = spark.createDataFrame([(*r, 1, "x", 3, "k") for r in rows], "doc_id long, text string, n_words int, `a.b` string, bucket int, score string").repartition(5)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got = ir.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, words(random.Random(2), 30)), (2, None)], "doc_id long, text string")
    assert ir.resample(none, some).collect() == []
    got = {r.doc_id: r for r in ir.resample(some, none, percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[2].weight == 0


def test_hashes_are_those_of_the_libraries(texts):
    w = ir.Words([(t or "").encode() for t in texts])
    hashed, of = ir.hashes(w), np.arange(len(w.starts))
    crc = ir.checksums(w, of)
    for i in range(0, len(w.starts), 7):
        assert hashed[i] == xxhash.xxh64_intdigest(w.stretch(i)) and crc[i] == zlib.crc32(w.stretch(i))


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_pieces_lose_no_pair(texts, size):
    for text in texts:
        found = collections.Counter(w.stretch(i).decode() for _, w in ir.pieces([(text or "").encode()], size) for i in range(len(w.starts)))
        assert found == collections.Counter(features(text)[1])


def test_equal_hashes_do_not_merge_different_bytes(texts):
    """Every key the same: only the compared bytes part the n-grams."""
    w = ir.Words([t.encode() for t in texts[:6]] + [("z" * 90 + " " + "z" * 89 + "y " + "z" * 90).encode()])
    table = ir.Table(w, hashed=np.zeros(len(w.starts), dtype=np.uint64))
    by_slot = collections.defaultdict(set)
    for i, slot in enumerate(table.slots):
        by_slot[slot].add(w.stretch(i))
    assert all(len(x) == 1 for x in by_slot.values()) and len(by_slot) == len({w.stretch(i) for i in range(len(w.starts))})
    for slot, stretches in by_slot.items():
        (one,) = stretches
        assert table.bucket[slot] == zlib.crc32(one) % ir.BUCKETS and table.count[slot] == sum(w.stretch(i) == one for i in range(len(w.starts)))
