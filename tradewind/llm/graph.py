"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node that has a lesser one."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are joined to its least neighbour, or to itself if it is less.

    Edges (u, v) have u > v, so a hub that is the least of its neighbours is not looked up by
    any row but its own edges', which Spark can split: nothing is gathered per node.
    """
    low = _least(edges).select(F.col("u").alias("v"), "m")
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours and the node itself are joined to the least of them."""
    low = _least(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (u long, v long), component the least node reachable.

    Every round is two shuffles of the surviving edges, written to the shared folder, and
    the number of rounds grows with the logarithm of the longest path. Nothing but two
    numbers a round reaches the driver. An empty edge table gives an empty result; loops
    and repeated edges change nothing.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(_MAX_ROUNDS):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, now = mark, stage(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")
