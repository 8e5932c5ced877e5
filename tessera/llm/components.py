"""Connected components by alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones with itself) are tied to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of edges (a long, b long): the smallest node reachable.

    Rounds write their edges to the shared folder; a node with very many edges is summed map-side, and its join is
    one that adaptive execution can split. Without edges there are no nodes.
    """
    now = scratch.write(edges.where("a != b").distinct(), f"{name}0")
    mark, k = _mark(now), 0
    while mark[0]:
        after = scratch.write(_star(_star(now, True), False), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}")
        now, k, before = after, k + 1, mark
        mark = _mark(now)
        if mark == before:
            break
        if k == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
