"""Stored tables: events, findings with their triggers, and the graph, as partitioned Parquet.

Writes replace only the partitions they touch, so a rerun of a channel replaces that channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.plans.correlate import Graph
from casegraph.plans.detect import Findings, rule_faults


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partitions:
        # One task per partition value would make a hot one slow: rows are only grouped by
        # the values, and adaptive execution may split large groups.
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    _write(events, f"{path}/events", "collection_id", "channel")


def read_events(
    spark: SparkSession, path: str, channels: list[str] | None = None, collections: list[str] | None = None
) -> DataFrame:
    """Stored events; channel and collection choices prune partitions."""
    events = spark.read.parquet(f"{path}/events")
    if channels:
        events = events.where(F.col("channel").isin(*channels))
    if collections:
        events = events.where(F.col("collection_id").isin(*collections))
    return events


def available_channels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/events").select("collection_id", "channel").distinct()


def write_findings(found: Findings, path: str) -> None:
    """Store both relations; what they share is stored by the rules' own stage tables."""
    _write(found.findings, f"{path}/findings", "collection_id", "channel")
    _write(found.triggers, f"{path}/triggers", "collection_id", "channel")
    _write(rule_faults(found.findings.sparkSession, found), f"{path}/rule_faults")


def read_rule_faults(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rule_faults")


def read_findings(spark: SparkSession, path: str, channels: list[str] | None = None) -> Findings:
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("findings", "triggers")]
    if channels:
        tables = [t.where(F.col("channel").isin(*channels)) for t in tables]
    return Findings(*tables)


GRAPH_TABLES = ("nodes", "edges", "skeleton", "actors", "node_events")


def write_graph(graph: Graph, path: str) -> None:
    for name in GRAPH_TABLES:
        _write(getattr(graph, name), f"{path}/graph_{name}", "collection_id")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/graph_{name}") for name in GRAPH_TABLES])


def write_summary(summary: DataFrame, path: str) -> None:
    _write(summary, f"{path}/summary", "collection_id")


def write_quarantine(rows: DataFrame, path: str) -> None:
    _write(rows, f"{path}/quarantine", "collection_id")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/quarantine")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/summary")
