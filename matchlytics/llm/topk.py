"""Exact top-k by inner product over an impact-ordered index, score at a time.

A task packs the vectors it reads into blocks. A block stores its postings (dimension, vector, value) in segments of
descending quantised impact, the power of two that |value| reaches. Query packs meet every block once. For a pair,
the segments are added from the highest impact down, all queries of the pack at once. After each segment the part of
a score that is still missing is at most |query| * |rest of the vector| (Cauchy-Schwarz), so a vector whose score so
far plus that bound is below the k-th best score so far minus its bound is proven out. Adding stops when few vectors
are left (or no segment is); those are scored exactly, in integers. The k best of all blocks are merged per query.

Blocks hold at most `block` vectors and query packs at most the queries of a block, so memory is bounded whatever the
table, and equal vectors are spread like any others. Vectors that are null or hold null or non-finite components take
no part. Shorter vectors count as filled up with zeros; components beyond 2^53 after quantisation, and vectors whose
products may leave 64 bits, raise an OverflowError. A null vec_id
is no query and comes last among ties. Rows with equal vec_id are different rows: each is a candidate for the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import kept_table

SCALE = 64.0
INDEX = "block long, n int, dims int, ids array<long>, levels array<int>, ends array<int>, post_dim binary, post_vec binary, post_value binary"
QUERIES = "pack long, n int, dims int, ids array<long>, places array<int>, weights binary"
FOUND = "pack long, place int, query_id long, vec_id long, block long, at int, score long"
#: Adding stops once at most this share of a pair's vectors is still possible.
FEW = 0.03


def quantised(vector) -> np.ndarray | None:
    """floor(64 * x) of the components, None where the vector takes no part."""
    if vector is None:
        return None
    x = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(SCALE * x)
    if len(x) and np.abs(x).max() > 2.0**53:
        raise OverflowError("a component is beyond the 53 bits that a double holds exactly")
    return x.astype(np.int64)


def postings(dense: np.ndarray):
    """Levels (descending), the end of each level's segment, and dimension, vector and value of the postings."""
    vec, dim = np.nonzero(dense)
    value = dense[vec, dim]
    level = np.frexp(np.abs(value).astype(np.float64))[1]
    order = np.lexsort((vec, dim, -level))
    level = level[order]
    ends = np.flatnonzero(np.r_[level[1:] != level[:-1], True]) + 1 if len(level) else np.zeros(0, dtype=np.int64)
    return level[ends - 1].tolist() if len(level) else [], ends.tolist(), dim[order].astype("<i4"), vec[order].astype("<i4"), value[order].astype("<i8")


def _packer(block: int, key: str, vector: str):
    def pack(frames):
        part, number, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def packed():
            dims = max((len(r) for r in rows), default=0)
            dense = np.zeros((len(rows), dims), dtype=np.int64)
            for i, r in enumerate(rows):
                dense[i, : len(r)] = r
            levels, ends, d, v, x = postings(dense)
            return pd.DataFrame([((part << 32) + number, len(rows), dims, ids, levels, ends, d.tobytes(), v.tobytes(), x.tobytes())], columns=[c.split()[0] for c in INDEX.split(", ")])

        for frame in frames:
            for vec_id, values in zip(frame[key], frame[vector], strict=True):
                r = quantised(values)
                if r is None:
                    continue
                ids.append(None if pd.isna(vec_id) else int(vec_id))
                rows.append(r)
                if len(rows) == block:
                    yield packed()
                    number, ids, rows = number + 1, [], []
        if rows:
            yield packed()
    return pack


def build_index(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """The index, kept as a table: one row per block, postings in segments of descending impact."""
    return kept_table(vectors.select(key, vector).mapInPandas(_packer(block, key, vector), INDEX), "impact-index")


def _dense(row, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(dims, n) matrix of the postings lo..hi of a block."""
    out = np.zeros((row.dims, row.n), dtype=np.int64)
    d, v, x = (np.frombuffer(b, dtype=t)[lo:hi] for b, t in ((row.post_dim, "<i4"), (row.post_vec, "<i4"), (row.post_value, "<i8")))
    out[d, v] = x
    return out


def _query_packer(every: int):
    def pick(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = [None if pd.isna(i) else int(i) for i in row.ids]
                places = [p for p, i in enumerate(ids) if i is not None and i % every == 0]
                if places:
                    yield pd.DataFrame([(row.block, len(places), row.dims, [ids[p] for p in places], places, np.ascontiguousarray(_dense(row)[:, places].T).tobytes())], columns=[c.split()[0] for c in QUERIES.split(", ")])
    return pick


def best_of_block(weights: np.ndarray, row, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact score) of all vectors of the block that may be among the k best of a query.

    `own` holds the place of the query itself in the block, or -1.
    """
    exact = _dense(row)
    dims = max(row.dims, weights.shape[1])
    exact = np.vstack([exact, np.zeros((dims - row.dims, row.n), dtype=np.int64)])
    weights = np.hstack([weights, np.zeros((len(weights), dims - weights.shape[1]), dtype=np.int64)])
    top = float(np.abs(exact).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, dims)
    if top >= 2.0**63:
        raise OverflowError("scores of these vectors may leave 64 bits")
    kind = np.float32 if top < 2.0**23 else np.float64
    slack = 0.0 if top < 2.0**52 else top * 2.0**-40  # sums of whole numbers are exact below
    q = weights.astype(kind)
    length = np.sqrt((weights.astype(np.float64) ** 2).sum(1))
    rest = (exact.astype(np.float64) ** 2).sum(0)
    so_far = np.zeros((len(q), row.n), dtype=kind)
    is_own = np.flatnonzero(own >= 0)
    at, possible = 0, np.ones((len(q), row.n), dtype=bool)
    for end in row.ends:
        part = _dense(row, at, end)
        at = end
        so_far[:] += q[:, : row.dims] @ part.astype(kind)
        rest = np.maximum(0.0, rest - (part.astype(np.float64) ** 2).sum(0))
        bound = (np.outer(length, np.sqrt(rest)) * (1 + 1e-9) + slack).astype(kind)
        if kind is np.float32:
            bound = np.nextafter(bound, np.float32(np.inf))
        low = so_far - bound
        low[is_own, own[is_own]] = -np.inf
        if row.n > k:
            least = np.partition(low, row.n - k, axis=1)[:, row.n - k]
            possible = so_far + bound >= least[:, None]
        if possible.mean() <= FEW:
            break
    possible[is_own, own[is_own]] = False
    i, j = np.nonzero(possible)
    score = np.empty(len(i), dtype=np.int64)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        score[b] = (weights[i[b]] * exact[:, j[b]].T).sum(1)
    return i, j, score


def _searcher(k: int):
    def search(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                weights = np.frombuffer(row.weights, dtype=np.int64).reshape(row.q_n, row.q_dims)
                places = np.asarray(row.places)
                own = places if row.pack == row.block else np.full(row.q_n, -1)
                i, j, score = best_of_block(weights, row, k, own)
                ids = np.array([np.iinfo(np.int64).max if pd.isna(x) else int(x) for x in row.ids], dtype=np.int64)
                order = np.lexsort((j, ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                i, j, score = i[keep], j[keep], score[keep]
                found = pd.DataFrame({"pack": row.pack, "place": places[i], "query_id": np.asarray(row.q_ids)[i], "vec_id": pd.array([None if pd.isna(row.ids[x]) else int(row.ids[x]) for x in j], dtype="Int64"), "block": row.block, "at": j, "score": score})
                yield found.astype({"pack": "int64", "place": "int32", "query_id": "int64", "block": "int64", "at": "int32"})
    return search


def search(index: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every vector whose id is divisible by `every`, itself left out."""
    shards = max(1, index.count())
    packs = index.mapInPandas(_query_packer(every), QUERIES)
    packs = packs.select("pack", F.col("n").alias("q_n"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), "places", "weights", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    blocks = index.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    pairs = blocks.join(packs, "shard").drop("shard")
    found = pairs.mapInPandas(_searcher(k), FOUND)
    best = Window.partitionBy("pack", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "block", "at")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
