"""Export of the whole graph as JSON lines, one folder per collection and kind of line.

Kinds are ``graph`` (one line: number of actors, addresses of the collector), ``node``, ``event`` (each
event that triggered a node, once) and ``edge``.  An edge line has one target and up to ``SLICE`` sources
of one contract or process, so a consumer with any number of sources has many lines, made by as many
tasks, and no value gathers them.  Empty members are left out of all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions import exprs as x
from casegraph.operators.linking import expand_links
from casegraph.plans import correlate as co
from casegraph.plans.correlate import Graph, numbered
from casegraph.plans.fuse import Fused
from casegraph.session import cut_lineage

c = F.col

SLICE = 1000


def edge_slices(providers: DataFrame, consumers: DataFrame, keys: list[str], untimed: str, size: int = SLICE) -> DataFrame:
    """``(keys, target, slice, sources)``: the sources of each target, at most ``size`` in a row.

    Providers of a key are numbered by time and id; a slice is a range of numbers, so all targets of a
    key have their sources cut at the same places.
    """
    key = F.to_json(F.struct(*keys))
    places = numbered(
        providers.select(*keys, "id", key.alias("_key"), F.struct(c("t").isNull().alias("u"), "t", "id").alias("_at")),
        "_key", "_at", "_no",
    )
    edges = expand_links(providers, consumers, keys, untimed)
    return (
        edges.join(places.select(*keys, c("id").alias("source"), F.floor(c("_no") / size).cast("int").alias("slice")), [*keys, "source"])
        .groupBy(*keys, "target", "slice")
        .agg(F.sort_array(F.collect_list("source")).alias("sources"))
    )


def edge_lines(fused: Fused, size: int = SLICE) -> DataFrame:
    """All causal edges of the graph in slices."""
    given, asked = co.match_contracts(*co.contract_sides(fused))
    contracts = edge_slices(given, asked.drop("ord"), co.CONTRACT_KEYS, "any", size)
    lineage = edge_slices(*co.lineage_sides(fused.findings), co.LINEAGE_KEYS, "both", size)

    def line(slices: DataFrame, relation: str, cap, kind) -> DataFrame:
        return slices.select(
            "collection_id", "target", "slice", "sources", F.lit(relation).alias("relation"), F.lit("causal").alias("nature"),
            cap.cast("string").alias("cap"), kind.cast("string").alias("match_kind"),
        )

    none = F.lit(None)
    return line(contracts, "requires/provides", c("cap"), c("match_kind")).unionByName(line(lineage, "parent", none, none))


def as_lines(rows: DataFrame, kind: str) -> DataFrame:
    """``collection_id, kind, line``: each row as JSON without empty members."""
    body = F.struct(*[c(f"`{n}`") for n in rows.columns if n != "collection_id"])
    typed = rows.select("collection_id", body.alias("_b"))
    return typed.select("collection_id", F.lit(kind).alias("kind"), x.pruned_json(c("_b"), typed.schema["_b"].dataType).alias("line"))


def graph_lines(graph: Graph, fused: Fused, collector_ips: DataFrame | None = None, size: int = SLICE) -> DataFrame:
    """All lines of the export; ``collector_ips`` has ``collection_id, collector_ip`` (an array)."""
    caps = fused.capabilities.select(c("finding_id").alias("id"), "role", F.struct("name", "bind", "values").alias("cap"))
    sides = caps.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(c("role") == "requires", c("cap")))).alias("requires"),
        F.sort_array(F.collect_set(F.when(c("role") == "provides", c("cap")))).alias("provides"),
    )
    triggers = graph.node_events.select("collection_id", c("finding_id").alias("node"), c("id").alias("event"))
    nodes = graph.nodes.join(sides, "id", "left")
    # Which events triggered a node is a line each: a mass deletion has any number of them.
    seen = graph.node_events.drop("finding_id").dropDuplicates(["collection_id", "id"])
    totals = graph.nodes.groupBy("collection_id").agg(F.count_distinct("actor").alias("actor_count"))
    if collector_ips is not None:
        totals = totals.join(collector_ips, "collection_id", "left")
    parts = {"graph": totals, "node": nodes, "trigger": triggers.distinct(), "event": seen, "edge": edge_lines(fused, size)}
    lines = [as_lines(rows, kind) for kind, rows in parts.items()]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def write_export(lines: DataFrame, path: str) -> None:
    """Text files of lines, by collection and kind; a large kind has many files."""
    stored = cut_lineage(lines)
    stored.hint("rebalance", c("collection_id"), c("kind")).write.mode("overwrite").partitionBy("collection_id", "kind").text(path)
