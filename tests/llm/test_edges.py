"""Edges of the corpus operators: long and unbroken texts, odd column names, reused names, several shards."""

import collections
import random
import re
import threading
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlytics.llm import components, jaccard_join, mixing, pii, quality, sentence_pieces, token_rollups, topk, warc
from matchlytics.llm.common import new_folder
from matchlytics.llm.queries import MODEL

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, ids string, round_trip string, _doc string, _text string, _sum string, _hit boolean"


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(sentence_pieces.model_pieces(open(MODEL, "rb").read()))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    texts = [text(90), text(70), "Mail jane@mail.example.org, Anna Miller.", None, ""]
    rows = [(i, t, "en", "s", None, "a", "b", "c", "d", "e", "f", None) for i, t in enumerate([*texts, texts[0]])]
    return spark.createDataFrame(rows, CLASHING).cache()


def test_stretches_end_where_no_piece_goes_on(pieces, monkeypatch):
    """Texts cut into many stretches are segmented like whole ones, runs of spaces longer than a stretch included."""
    rng = random.Random(2)
    texts = ["x " + " " * 300 + "hello world", " " * 500, "a" * 400 + " b", "hello" + " " * 70 + "wonderful " * 30, "梦" * 200 + " x"]
    texts += ["".join(rng.choice(["  ", " ", "hello", "wo", "\n", "é"]) for _ in range(200)) for _ in range(20)]
    whole = [ids.tolist() for ids in pieces.encode_all(texts)]
    monkeypatch.setattr(sentence_pieces, "PIECE_OF_TEXT", 64)
    for few in (0, 16, 10**9):
        monkeypatch.setattr(sentence_pieces, "FEW_WORDS", few)
        pieces.known.clear()
        assert [ids.tolist() for ids in pieces.encode_all(texts)] == whole
    pieces.known.clear()


def test_run_of_a_million_spaces(pieces):
    text = "x " + " " * (1 << 20) + "hello world"
    (ids,) = pieces.encode_all([text])
    assert pieces.decode(ids) == text and ids[-2:].tolist() == pieces.encode_all(["hello world"])[0][-2:].tolist()


def test_unbroken_text_costs_no_more_than_ten_times_spaced_text(pieces):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    spaced = re.sub("(.{5})", r"\1 ", letters)
    took = []
    for text in (spaced, letters):
        pieces.known.clear()
        start = time.thread_time()
        (ids,) = pieces.encode_all([text])
        took.append(time.thread_time() - start)
        assert pieces.decode(ids) == text
    assert took[1] <= 10 * max(took[0], 0.02)


def test_clashing_and_dotted_columns(spark, odd):
    made = sentence_pieces.encode(odd, MODEL, round_trip="round_trip").collect()
    assert all(r.round_trip for r in made) and "a.b" in made[0].asDict()
    assert sorted(r["a.b"] for r in pii.with_surrogates(odd, key=b"k", count="n").collect()) == ["a"] * 6
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(odd, labels).columns == odd.columns
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(odd).collect()) == [0, 1, 2, 3, 4]
    assert mixing.Mix(odd, block=8).texts().columns == odd.columns


def test_scores_beyond_64_bits_are_an_error(spark):
    for rows in ([(20, [1e9] * 8), (1, [3e15] * 8)], [(20, [1e300, 0.0])]):
        with pytest.raises(Exception, match="OverflowError"):
            topk.search(topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()


def test_names_later_in_a_text_and_in_capitals():
    text = "Anna Miller met Tom. Later Miller said hi to Anna, and MILLER left. JOHN PETERS stayed with Mr. Klein; klein is small."
    found = pii.mentions(text)
    seen = collections.Counter((kind.split(":")[0], value) for _, _, kind, value in found)
    assert seen == {("given", "anna"): 2, ("family", "miller"): 3, ("given", "john"): 1, ("family", "peters"): 1, ("family", "klein"): 1}
    table = {(kind, value): pii.surrogate(b"k", kind, value, 0) for _, _, kind, value in found}
    parts, at = [], 0
    for a, b, kind, value in found:
        parts += [text[at:a], pii.rendered(kind, table[kind, value], text[a:b])]
        at = b
    out = "".join([*parts, text[at:]])
    assert not re.search("(?i)miller|anna|peters|Klein", out.replace("klein is small", ""))


def test_names_in_capitals_pass_the_gate(spark):
    df = spark.createDataFrame([("JOHN MILLER",), ("Anna Schmidt",), ("john miller",)], "text string")
    assert [r.g for r in df.select(pii.gate(F.col("text")).alias("g")).collect()] == [True, True, False]


KIND = "change_id string, op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_batches_are_committed_once(spark):
    store = new_folder(spark, "store")
    batch = lambda n: spark.createDataFrame([(str(n), "insert", "a", None, "t", n, None)], KIND)
    added = []
    threads = [threading.Thread(target=lambda: added.append(token_rollups.commit(store, "b/1", batch(5)))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(added) == [False, False, False, True]
    with pytest.raises(ValueError, match="other changes"):
        token_rollups.commit(store, "b/1", batch(6))
    assert [tuple(r) for r in token_rollups.totals(spark, store).collect()] == [("a", None, "t", 1, 5, 1)]
    assert token_rollups.snapshot(spark, store) and not token_rollups.snapshot(spark, store)
    token_rollups.commit(store, "b 2", batch(7))
    rows, batches, later = token_rollups._sums(spark, store)
    assert batches == ["b 2", "b/1"] and later == ["b 2"] and rows.count() == 2
    assert [tuple(r) for r in token_rollups.totals(spark, store).collect()] == [("a", None, "t", 2, 12, 2)]
    assert token_rollups.snapshot(spark, store) and token_rollups._sums(spark, store)[0].count() == 1
    assert token_rollups.totals(spark, new_folder(spark, "none")).collect() == []


def test_mix_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 50)
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice("aab")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=4, shard_slots=64)
    drawn = mix.drawn.collect()
    shards = collections.Counter()
    for r in drawn:
        shards[r.shard] += r["count"]
    assert len(shards) > 20 and all(n == 64 for s, n in shards.items() if s < max(shards))
    assert mix.slots.rdd.getNumPartitions() == mix.slot_tasks > 20
    slots = collections.Counter((r.src, r.epoch, r.block) for r in mix.slots.collect())
    assert max(slots.values()) == 1 and sum(slots.values()) == sum(shards.values())  # no epoch takes a block twice
    took = collections.Counter()
    for r in mix.taken().collect():
        assert r.taken <= 3 * r.size
        took[r.target] += r.taken
    assert all(abs(n - t) <= 0.02 * t + 16 for t, n in took.items())


def test_archives_are_read_in_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", np.random.default_rng(i).bytes(3000).hex()) for i in range(60)], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    index = warc.write_archives(pages, folder, min_bytes=0)
    records = warc.read_records(index, folder, stretch=20_000)
    assert records.rdd.getNumPartitions() >= 5 and records.count() == 60


@pytest.mark.parametrize("per_task", [1 << 16, 20])
def test_rounds_write_as_many_files_as_links_ask_for(spark, monkeypatch, per_task):
    """Every file of a round starts processes on local disks, so a few links don't come in a file per partition."""
    files, keep = [], components.kept_table

    def kept(df, name):
        out = keep(df, name)
        if name == "stars":
            files.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(components, "kept_table", kept)
    monkeypatch.setattr(components, "LINKS", per_task, raising=False)
    aqe = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(aqe, "false")
    try:
        links = spark.createDataFrame([(i, i + 20) for i in range(60)], "a long, b long")
        out = components.components(links)
        parts, got = out.rdd.getNumPartitions(), {r["node"]: r["component"] for r in out.collect()}
    finally:
        spark.conf.unset(aqe)
    assert got == {i: i % 20 for i in range(80)}
    most = -(-60 // per_task)
    assert files and max(files) <= most and parts <= most


def test_memory_of_a_worker():
    """Words that are remembered, and texts while they are hashed, take little room in a worker."""
    pieces = sentence_pieces.Pieces(sentence_pieces.model_pieces(open(MODEL, "rb").read()))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(6_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    tracemalloc.start()
    try:
        pieces.encode_all(texts)
        per_word = tracemalloc.get_traced_memory()[0] / len(pieces.known)
        jaccard_join._POWERS.clear()
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        sets = jaccard_join.shingle_sets(texts * 30)
        now, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    result = sum(s.nbytes for s in sets)
    assert per_word < 220 and peak - before - result < 40e6
