"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_of(edges: DataFrame) -> DataFrame:
    """(u, m, tl_n): the least neighbour of each node, and how many there are."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("tl_n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours, in a table that takes the place of edges."""
    near = _both_ways(edges)
    least = written(_least_of(near).select("u", F.least("u", "m").alias("m"), "tl_n"), "least")
    out = written(spread(near.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    discard(edges, least)
    return out


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of these, in a table that takes the place of edges."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(_least_of(down), "least")
    moved = spread(down, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(edges, least)
    return out


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge (u, v); root is the smallest node of its component.

    Each round is a few aggregations and joins keyed by node; the lineage is cut by a written table after each, and the table
    before it is deleted. Rounds needed grow with the logarithm of the longest path. No node's neighbours are ever gathered in
    one row or, for a hub, in one task.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or (now["n"], now["h"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (now["n"], now["h"])
        edges = _small_star(_large_star(edges, now["n"]), now["n"])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
