"""Graph measures over an edge table: longest-path rank, lanes, subgraph, neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.session import cut_lineage

c = F.col


def _jumps(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that need rounds (heads), and for each other node its head and the steps from there.

    A node with one predecessor has that one's rank plus one, so only nodes without or with several
    predecessors are heads.  The others' pointers to their predecessors are doubled until they reach a
    head, in as many steps as the longest chain's length has bits.  Pointers that never do run in a
    cycle; they have no head (``found`` is false).
    """
    single = (
        links.groupBy(c("target").alias("id"))
        .agg(F.count(F.lit(1)).alias("k"), F.min("source").alias("to"))
        .where("k = 1")
        .drop("k")
    )
    single = cut_lineage(single)
    heads = cut_lineage(ids.join(single, "id", "left_anti"))
    known = heads.select(c("id").alias("to"), F.lit(True).alias("head"))
    jumps = cut_lineage(
        single.join(known, "to", "left").select("id", "to", F.lit(1).alias("steps"), F.coalesce("head", F.lit(False)).alias("found"))
    )
    for _ in range(max(1, single.count()).bit_length() + 1):
        moving = jumps.where("NOT found")
        if moving.isEmpty():
            break
        further = jumps.select(c("id").alias("to"), c("to").alias("to2"), c("steps").alias("steps2"), c("found").alias("found2"))
        moved = moving.join(further, "to").select(
            "id", c("to2").alias("to"), (c("steps") + c("steps2")).alias("steps"), c("found2").alias("found")
        )
        jumps = cut_lineage(jumps.where("found").unionByName(moved))
    return heads, jumps


def longest_path_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, rank)``: length of the longest path that reaches each node from a root.

    Chains are taken in one step each (:func:`_jumps`).  The other nodes leave in rounds once all their
    predecessors have left.  A node behind a cycle keeps the largest rank its finished predecessors
    gave it.  ``edges``: source, target; repeated edges count.
    """
    ids = nodes.select("id").distinct()
    links = (
        edges.join(ids.select(c("id").alias("source")), "source", "left_semi")
        .join(ids.select(c("id").alias("target")), "target", "left_semi")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    links = cut_lineage(links)
    heads, jumps = _jumps(links, ids)
    # Edges between heads, as long as the chains they stand for; those out of a cycle stay open.
    own = heads.select(c("id").alias("source"), c("id").alias("to"), F.lit(0).alias("steps"), F.lit(True).alias("found"))
    start = own.unionByName(jumps.select(c("id").alias("source"), "to", "steps", "found"))
    into = cut_lineage(
        links.join(heads.select(c("id").alias("target")), "target", "left_semi").join(start, "source")
        .select("to", "target", (c("steps") + 1).alias("steps"), "n", "found")
    )
    waiting = into.groupBy(c("target").alias("id")).agg(F.sum("n").alias("open"))
    state = cut_lineage(
        heads.join(waiting, "id", "left").select(
            "id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("rank")
        )
    )
    passable = into.where("found")
    done: DataFrame | None = None
    while True:
        leaving = state.where("open = 0").select("id", "rank")
        if leaving.isEmpty():
            break
        # Each edge is used once over all rounds: in the round its source leaves.
        reached = (
            passable.join(leaving, passable["to"] == leaving["id"])
            .groupBy(c("target").alias("id"))
            .agg(F.sum("n").alias("closed"), F.max(c("rank") + c("steps")).alias("via"))
        )
        done = leaving if done is None else done.unionByName(leaving)
        state = cut_lineage(
            state.where("open > 0")
            .join(reached, "id", "left")
            .select(
                "id",
                (c("open") - F.coalesce("closed", F.lit(0))).alias("open"),
                F.greatest("rank", "via").alias("rank"),
            )
        )
    rest = state.select("id", "rank")
    if done is None:
        return rest.unionByName(jumps.select("id", F.lit(0).alias("rank")))
    behind = jumps.join(done.select(c("id").alias("to"), c("rank").alias("of_head")), "to", "left").select(
        "id", F.when(c("found") & c("of_head").isNotNull(), c("of_head") + c("steps")).otherwise(0).alias("rank")
    )
    return done.unionByName(rest).unionByName(behind)


def lane_order(phase: Column) -> Column:
    """Position of a kill-chain phase; unknown phases come last."""
    known = F.array(*[F.lit(p) for p in fv.KILL_CHAIN_PHASES])
    at = F.array_position(known, phase)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(fv.KILL_CHAIN_PHASES)))


def lane_counts(ranked: DataFrame) -> DataFrame:
    """Nodes per (phase, rank) with the widest cell of each phase (``ranked``: phase, rank)."""
    cells = ranked.groupBy("phase", "rank").agg(F.count(F.lit(1)).alias("nodes"))
    widest = cells.groupBy("phase").agg(F.max("nodes").alias("widest"))
    return cells.join(widest, "phase").withColumn("lane", lane_order(c("phase")))


def subgraph(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that meet the condition, and the edges with both ends among them."""
    kept = nodes.where(condition)
    ids = kept.select("id").distinct()
    inner = edges.join(ids.select(c("id").alias("source")), "source", "left_semi").join(
        ids.select(c("id").alias("target")), "target", "left_semi"
    )
    return kept, inner


def neighbourhood(edges: DataFrame, node: Column) -> DataFrame:
    """The node and everything one edge away from it."""
    touching = edges.where((c("source") == node) | (c("target") == node))
    return touching.select(F.explode(F.array("source", "target")).alias("id")).distinct()
