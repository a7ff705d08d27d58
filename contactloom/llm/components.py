"""Connected components of link tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("_m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (``u, v``); the root is the least node reachable.

    Each round hangs larger neighbours to the least neighbour (large star), then smaller ones (small star),
    until the links are stars around the roots. The edge set never grows beyond its first
    size, and rounds grow with the logarithm of the longest chain. Rounds are written to the
    shared folder, so a lost executor costs one round. Nodes are of any ordered type; loops
    and repeated edges do nothing.
    """
    edges = stored(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .filter("u < v")
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u")
            .filter("v > u")
            .select(F.least("u", "_m").alias("u"), "v")
            .distinct()
        )
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least_neighbour(down)
        small = (
            down.join(least, "u")
            .select(F.col("_m").alias("u"), "v")
            .unionByName(least.select(F.col("_m").alias("u"), F.col("u").alias("v")))
            .filter("u < v")
            .distinct()
        )
        edges = stored(small)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
