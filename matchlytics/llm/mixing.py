"""Mixing sources to target weights, by blocks of words.

The words of a source, its documents in a fixed order, are packed into blocks of `block` words. Every output shard
draws how many of its slots each source fills (multinomial); the counts still owed to the sources are the weights
of the next draw, so the draws of all shards add up to the sources' targets. The running slot number k of a source
is mapped to epoch k // n and to a block by a keyed pseudorandom permutation of the source's n blocks, so an epoch
takes every block once and no text is taken more often than the number of epochs. Slots and blocks meet in a join
by (source, block), which has many keys per source, so a source with a third of all words is spread like any other.

What goes through the driver is one row per source (its size and target) and the drawn counts, one number per
source and shard of `shard_slots` blocks; texts and words never do.

Null text has size 0; a null source is a source of its own, the last one; repeated rows are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, WORD, kept_table, let, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights, *, cap: float = 3.0) -> list[float]:
    """Shares of the whole by weight, none above `cap` times its size; what a cap cuts off is shared again."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in sorted(full):
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def draws(owed: np.ndarray, shard_slots: int, seed: int) -> list[np.ndarray]:
    """Counts per source for each output shard. A source drawn beyond what it is owed gives the excess back to a new draw."""
    rng, out, owed = np.random.default_rng(seed), [], owed.astype(np.int64).copy()
    while owed.sum():
        free, counts = min(shard_slots, int(owed.sum())), np.zeros_like(owed)
        while free:
            rest = owed - counts
            counts = counts + np.minimum(rng.multinomial(free, rest / rest.sum()), rest)
            free = min(shard_slots, int(owed.sum())) - int(counts.sum())
        out.append(counts)
        owed -= counts
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of 0..n-1 at `index`: a Feistel network on the next even number of bits, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, key, n = (np.uint64(1) << half) - np.uint64(1), key.astype(np.uint64), n.astype(np.uint64)

    def once(x, half, mask, key):
        left, right = x >> half, x & mask
        for no in range(6):
            h = (right + key + np.uint64(0x9E3779B97F4A7C15 * (no + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64), half, mask, key)
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = once(out[over], half[over], mask[over], key[over])
    return out.astype(np.int64)


def _slot_blocks(seed: int):
    """Function for mapInPandas: (shard, src, first, count, n) to (shard, src, epoch, block) per slot, in bounded pieces."""
    def slots(frames, piece=1 << 18):
        for frame in frames:
            for shard, src, first, count, n in frame[["shard", "src", "first", "count", "n"]].itertuples(index=False):
                for a in range(0, count, piece):
                    k = np.arange(first + a, first + min(count, a + piece), dtype=np.int64)
                    epoch = k // n
                    keys = [hashlib.blake2b(f"{seed}/{src}/{e}".encode(), digest_size=8).digest() for e in range(epoch[0], epoch[-1] + 1)]
                    keys = np.array([int.from_bytes(x, "little") for x in keys], dtype=np.uint64)
                    block = permuted(k % n, np.full(len(k), n, dtype=np.int64), keys[epoch - epoch[0]])
                    yield pd.DataFrame({"shard": np.full(len(k), shard, dtype=np.int64), "src": np.full(len(k), src, dtype=np.int64), "epoch": epoch, "block": block})
    return slots


class Mix:
    """A drawn mix of `docs`: `documents` (kept numbers per document), `parts` and `slots` (block by block)."""

    #: Up to so many sources their table is broadcast (some MB); with more it is joined by a shuffle.
    BROADCAST_SOURCES = 50_000

    def __init__(self, docs: DataFrame, *, weights=WEIGHTS, cap: float = 3.0, block: int = 32, shard_slots: int = 1 << 16, seed: int = 1, key: str = "doc_id", source: str = "source", text: str = "text"):
        self.docs, self.block, self.seed, self.text = docs, block, seed, text
        rows = kept_table(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *row_keys(docs)), "sizes")
        found = [(r["source"], int(r["size"]), r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()]
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [r[1] for r in found]
        share = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap=cap)
        blocks = [-(-n // block) for n in sizes]
        owed = np.array([min(int(cap) * b, round(t * b / n)) if n else 0 for t, b, n in zip(share, blocks, sizes, strict=True)], dtype=np.int64)
        self.slot_tasks = max(1, -(-int(owed.sum()) // SLOTS))
        spark = docs.sparkSession
        table = [(i, name, n, t, -(-count // CHUNK)) for i, ((name, n, count), t) in enumerate(zip(found, share, strict=True))]
        sources = spark.createDataFrame(table, "src long, name string, source_size long, target double, chunks long")
        if len(table) <= self.BROADCAST_SOURCES:
            sources = F.broadcast(sources)
        rows = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        self.documents = kept_table(with_starts(rows), "starts")
        drawn, first = [], np.zeros(len(owed), dtype=np.int64)
        for shard, counts in enumerate(draws(owed, shard_slots, seed)):
            drawn += [(shard, int(i), int(first[i]), int(counts[i]), blocks[i]) for i in np.flatnonzero(counts)]
            first += counts
        self.drawn = spark.createDataFrame(drawn, "shard long, src long, first long, count long, n long")

    @property
    def slots(self) -> DataFrame:
        """(shard, src, epoch, block) of every slot of every output shard."""
        # a number of its own: by the bytes of the drawn rows all slots would be made in one task
        return self.drawn.repartition(self.slot_tasks, "shard", "src").mapInPandas(_slot_blocks(self.seed), "shard long, src long, epoch long, block long")

    @property
    def parts(self) -> DataFrame:
        """(src, block, start, lo, hi, k1, k2, size): the words lo..hi-1 of a document that a block holds."""
        b, end = F.lit(self.block), F.col("start") + F.col("size")
        rows = self.documents.filter("size > 0").select("src", "start", "size", "k1", "k2", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block"))
        low, high = F.greatest(F.col("block") * b, F.col("start")), F.least((F.col("block") + 1) * b, end)
        return rows.select("src", "block", "start", "size", "k1", "k2", (low - F.col("start")).alias("lo"), (high - F.col("start")).alias("hi"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) per document."""
        times = self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
        took = self.parts.select("src", "block", "start", (F.col("hi") - F.col("lo")).alias("n")).join(times, ["src", "block"])
        took = took.groupBy("src", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
        rows = self.documents.withColumn("_at", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.xxhash64("k1"), F.lit(1 << 20))))
        took = took.select(F.col("src").alias("_src"), F.col("start").alias("_start"), "taken")
        out = rows.join(took, (F.col("src") == F.col("_src")) & (F.col("_at") == F.col("_start")), "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

    def texts(self) -> DataFrame:
        """The mix itself, in the columns of the documents: one row per document and epoch that took words of it.

        The text is the document's whole text where the epoch took all its words, else the taken stretches in order.
        """
        picks = self.parts.join(self.slots, ["src", "block"]).groupBy("k1", "k2", "start", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
        whole = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["hi"] - c["lo"]) == F.col("size")
        picks = picks.select("k1", "k2", F.when(~whole, F.col("cuts")).alias("_cuts"))
        one = Window.partitionBy("k1", "k2").orderBy("k2")
        docs = self.docs.select(whole_row(self.docs).alias("_doc"), *row_keys(self.docs)).withColumn("_no", F.row_number().over(one)).filter("_no = 1").drop("_no")
        rows = docs.join(picks, ["k1", "k2"])
        pieces = F.regexp_extract_all(F.col(f"_doc.{self.text}"), F.lit(f"{SPACE}*{WORD}"), F.lit(0))
        cut = let(F.struct(pieces.alias("w"), F.col("_cuts").alias("c")), lambda x: F.array_join(F.flatten(F.transform(x["c"], lambda c: F.slice(x["w"], (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))), ""))
        cut = F.regexp_replace(cut, f"^{SPACE}+", "")
        rows = rows.withColumn("_text", F.when(F.col("_cuts").isNull(), F.col(f"_doc.{self.text}")).otherwise(cut))
        new = {self.text: F.col("_text"), "n_chars": F.length("_text").cast("long")}
        return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in self.docs.columns])


#: Documents of a source that are ordered together.
CHUNK = 1 << 14
#: Slots that a task makes, about.
SLOTS = 1 << 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits of hash over all columns of a row; rows with equal keys are copies of one another."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    known = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *known).alias("k1"), F.xxhash64(F.lit("second"), *known, *cols).alias("k2")]


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the first word of the document in its source's row of words.

    Documents are dealt into chunks by a hash, as many as the source's number of documents asks for; a chunk is ordered
    by itself, and only the sums of chunks are ordered per source.
    """
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("k1"), F.col("chunks"))).repartition("src", "_c")
    inside = Window.partitionBy("src", "_c").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
    sums = rows.groupBy("src", "_c").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("src").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "_c", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return rows.join(sums, ["src", "_c"]).withColumn("start", F.col("_off") + F.col("_in")).drop("_off", "_in", "_c", "chunks")
