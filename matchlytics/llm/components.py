"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table

#: Links that a task of a round writes, about.
LINKS = 1 << 16


def _minima(near: DataFrame) -> DataFrame:
    return near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node hands the least node it knows first to its larger neighbours, then to the others."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = _minima(large)
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.filter("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b")).distinct()


def components(links: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, component) of all nodes of links (a, b); the component is its least node.

    The number of rounds grows with the logarithm of the longest chain. Each round is kept as a table, of as many files as
    its links ask for: no round has more links than the one before, and on local disks each file starts processes.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = kept_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = mark(edges)
    tasks = max(1, -(-state[0] // LINKS))
    for _ in range(rounds):
        edges = kept_table(_stars(edges).coalesce(tasks), "stars")
        new = mark(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not closed after {rounds} rounds")
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()).coalesce(tasks)
