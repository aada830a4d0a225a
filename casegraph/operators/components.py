"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins whose right side is unique per key, so a hub
node never gathers its neighbours in one task: minima combine on the map side and adaptive
execution may split the skewed left side.  The number of rounds grows with the logarithm of
the largest component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.session import cut_lineage


def _minimum_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum_neighbour(both).select("u", F.least("u", "low").alias("low"))
    return (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.where("u <> v").unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(
    edges: DataFrame,
    source: str = "src",
    target: str = "dst",
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
    drop: Callable[[DataFrame], None] = lambda _: None,
) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    The component is the smallest node id in it.  Rounds run until the edges stop changing.  ``keep``
    stores a round's edges: long ids, which repeat, take much less as a table than as a checkpoint.  ``drop``
    gives them back after the next round.
    """
    nodes = edges.select(F.col(source).alias("node")).unionByName(
        edges.select(F.col(target).alias("node"))
    )
    current = keep(
        edges.where(F.col(source) != F.col(target))
        .select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v"))
        .distinct()
    )
    seen = _checksum(current)
    while seen[0]:
        last, current = current, keep(_small_star(_large_star(current)))
        drop(last)
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (
        nodes.distinct()
        .join(stars, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
