"""Reports over events, findings and the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from casegraph.functions import exprs as x

c = F.col
lit = F.lit

LISTING = [
    "id",
    "timestamp",
    "rule_id",
    "rule_name",
    "rule_type",
    "severity",
    "confidence",
    "kill_chain_phase",
    "tactic",
    "technique_id",
    "technique_name",
    "source",
    "description",
    "tags",
    "event_count",
    "entities",
]


def rank_label(rank: Column, empty: str) -> Column:
    return F.coalesce(x.severity_label(rank), lit(empty))


# ------------------------------------------------------------------ counts and severities
def channel_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Event count per channel, largest first."""
    return (
        events.groupBy(*(keys or ("channel",)))
        .agg(F.count(lit(1)).alias("events"))
        .orderBy(c("events").desc(), *(keys or ("channel",)))
    )


def finding_summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Finding count and highest severity per group; ``info`` where nothing is known."""
    rank = F.max(x.severity_rank(c("severity")))
    return findings.groupBy(*keys).agg(
        F.count(lit(1)).alias("findings"), rank_label(rank, "info").alias("max_severity")
    )


def sticky_severity(stored: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Highest severity ever seen: it starts at ``low`` and never falls.

    ``stored``: key and the severity kept so far (may be null).
    """
    now = findings.groupBy(key).agg(F.max(x.severity_rank(c("severity"))).alias("now"))
    return stored.join(now, key, "full").select(
        key,
        x.severity_label(
            F.greatest(lit(1), x.severity_rank(c("max_severity")), c("now"))
        ).alias("max_severity"),
    )


def findings_listing(findings: DataFrame) -> DataFrame:
    """Flat listing, most severe first, newest first among equals."""
    return findings.select(*LISTING).orderBy(
        x.severity_rank(c("severity")).desc(), c("timestamp").desc_nulls_last(), "id"
    )


def collection_list(
    collections: DataFrame, events: DataFrame, findings: DataFrame, actors: DataFrame
) -> DataFrame:
    """Collections with totals, actor count, highest severity and whether a collector ran."""
    key = "collection_id"
    return (
        collections.join(events.groupBy(key).agg(F.count(lit(1)).alias("event_count")), key, "left")
        .join(
            findings.groupBy(key).agg(
                F.count(lit(1)).alias("finding_count"),
                F.max(x.severity_rank(c("severity"))).alias("_rank"),
            ),
            key,
            "left",
        )
        .join(
            actors.groupBy(key).agg((F.max("actor") + 1).alias("actor_count")), key, "left"
        )
        .select(
            key,
            "hostname",
            "collected_at",
            F.coalesce("event_count", lit(0)).alias("event_count"),
            F.coalesce("finding_count", lit(0)).alias("finding_count"),
            "actor_count",
            x.severity_label(c("_rank")).alias("max_severity"),
        )
    )


def host_rollup(scans: DataFrame, search: str = "") -> DataFrame:
    """Per host: latest scan, highest severity, most findings and actors, number of scans."""
    latest = F.max(F.struct("collected_at", "collection_id"))
    rows = scans.where(F.lower("host").contains(search.lower())) if search else scans
    return (
        rows.groupBy("host")
        .agg(
            latest.alias("latest"),
            F.max(x.severity_rank(c("max_severity"))).alias("rank"),
            F.max("finding_count").alias("max_findings"),
            F.max("actor_count").alias("max_actors"),
            F.count(lit(1)).alias("total_scans"),
        )
        .select(
            "host",
            c("latest.collection_id").alias("latest_scan"),
            c("latest.collected_at").alias("latest_at"),
            x.severity_label(c("rank")).alias("max_severity"),
            "max_findings",
            "max_actors",
            "total_scans",
        )
        .orderBy(c("latest_at").desc(), "host")
    )


# ------------------------------------------------------------------ listing filters
def facets(findings: DataFrame, *columns: str) -> DataFrame:
    """Values present in each column with their counts."""
    pairs = F.explode(F.array(*[F.struct(lit(n).alias("facet"), c(n).alias("value")) for n in columns]))
    return (
        findings.select(pairs.alias("f"))
        .where(c("f.value").isNotNull() & (c("f.value") != "—"))
        .groupBy("f.facet", "f.value")
        .agg(F.count(lit(1)).alias("n"))
    )


def search_findings(
    findings: DataFrame,
    text: str = "",
    severities: tuple[str, ...] = (),
    phases: tuple[str, ...] = (),
) -> DataFrame:
    """Findings of the chosen severities and phases whose fields or tags contain the text."""
    out = findings
    if severities:
        out = out.where(c("severity").isin(*severities))
    if phases:
        out = out.where(c("kill_chain_phase").isin(*phases))
    needle = text.strip().lower()
    if needle:
        fields = [
            c("rule_name"),
            c("kill_chain_phase"),
            c("severity"),
            c("timestamp").cast("string"),
            c("source"),
            c("technique_id"),
            c("description"),
        ]
        hits = [F.coalesce(F.lower(f).contains(needle), lit(False)) for f in fields]
        hits.append(F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(needle)), lit(False)))
        out = out.where(x.any_of(hits))
    return out


# ------------------------------------------------------------------ nested events as rows
def _leaves(schema: StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Dotted names and text of all scalar leaves of a schema; lists are joined."""
    out: list[tuple[str, Column]] = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        column = c(".".join(f"`{p}`" for p in path.split(".")))
        kind = field.dataType
        if isinstance(kind, StructType):
            out += _leaves(kind, path)
        elif isinstance(kind, ArrayType):
            text = (
                F.transform(column, lambda e: F.to_json(e))
                if isinstance(kind.elementType, StructType)
                else column.cast("array<string>")
            )
            out.append((path, F.array_join(text, ", ")))
        elif not isinstance(kind, MapType):
            out.append((path, column.cast("string")))
    return out


def _maps(schema: StructType, prefix: str = "") -> list[str]:
    found = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, StructType):
            found += _maps(field.dataType, path)
        elif isinstance(field.dataType, MapType):
            found.append(path)
    return found


def flatten_events(events: DataFrame, keys: tuple[str, ...] = ("collection_id", "id")) -> DataFrame:
    """(keys, name, value) rows of every non-null leaf of nested events."""
    body = StructType([f for f in events.schema.fields if f.name not in keys])
    entries = F.array_compact(
        F.array(
            *[
                F.when(text.isNotNull(), F.struct(lit(name).alias("name"), text.alias("value")))
                for name, text in _leaves(body)
            ]
        )
    )
    for path in _maps(body):
        items = F.transform(
            F.filter(F.map_entries(c(path)), lambda e: e["value"].isNotNull()),
            lambda e, p=path: F.struct(
                F.concat(lit(f"{p}."), e["key"]).alias("name"), e["value"].alias("value")
            ),
        )
        entries = F.concat(
            entries, F.coalesce(items, F.array().cast("array<struct<name:string,value:string>>"))
        )
    return events.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def search_nodes(nodes: DataFrame, node_events: DataFrame, text: str) -> DataFrame:
    """Nodes whose fields contain the text, else those with a trigger event that does."""
    needle = text.strip().lower()
    fields = [
        c("label"),
        *[c(f"fields.{n}") for n in ("kill_chain", "severity", "user", "process", "source_ip", "timestamp")],
    ]
    direct = x.any_of([F.coalesce(F.lower(f).contains(needle), lit(False)) for f in fields])
    # The whole event as text is a cheap first test; the exact one looks at single leaves.
    likely = node_events.where(
        F.lower(F.to_json(F.struct(*[n for n in node_events.columns if n != "finding_id"]))).contains(
            needle.replace("\\", "\\\\").replace('"', '\\"')
        )
    )
    deep = (
        flatten_events(likely, ("collection_id", "finding_id"))
        .where(F.lower("value").contains(needle))
        .select("collection_id", c("finding_id").alias("id"))
        .distinct()
        .withColumn("_deep", lit(True))
    )
    return (
        nodes.join(deep, ["collection_id", "id"], "left")
        .where(direct | F.coalesce("_deep", lit(False)))
        .drop("_deep")
    )


# ------------------------------------------------------------------ actors
def _own_nodes(nodes: DataFrame, collector_ips: tuple[str, ...]) -> DataFrame:
    """Nodes whose address is not one of the collector's own."""
    if not collector_ips:
        return nodes
    ip = c("fields.source_ip")
    return nodes.where(ip.isNull() | ~ip.isin(*collector_ips))


def phase_span(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, lit(" → "), last))


def actor_summary(nodes: DataFrame, collector_ips: tuple[str, ...] = ()) -> DataFrame:
    """Per actor: nodes, the address of its most severe node that has one, severity, phases."""
    rank = x.severity_rank(F.lower("fields.severity"))
    when = F.struct(c("event_time").isNotNull().alias("known"), c("event_time").alias("t"), c("id").alias("i"))
    return (
        _own_nodes(nodes, collector_ips)
        .where(c("actor").isNotNull())
        .withColumn("_when", when)
        .groupBy("collection_id", "actor")
        .agg(
            F.count(lit(1)).alias("nodes"),
            F.min(
                F.when(
                    c("fields.source_ip").isNotNull(),
                    F.struct((-rank).alias("r"), c("id").alias("i"), c("fields.source_ip").alias("ip")),
                )
            )["ip"].alias("_ip"),
            F.max(rank).alias("_rank"),
            F.min(F.struct("_when", c("fields.kill_chain").alias("p")))["p"].alias("_first"),
            F.max(F.struct("_when", c("fields.kill_chain").alias("p")))["p"].alias("_last"),
        )
        .select(
            "collection_id",
            "actor",
            "nodes",
            F.coalesce("_ip", F.format_string("ID: %d", "actor")).alias("label"),
            rank_label(c("_rank"), "—").alias("max_severity"),
            phase_span(c("_first"), c("_last")).alias("phases"),
        )
    )


def isolated_findings(nodes: DataFrame, collector_ips: tuple[str, ...] = ()) -> DataFrame:
    """Findings that belong to no actor, by time."""
    return _own_nodes(nodes, collector_ips).where(c("actor").isNull()).orderBy("event_time", "id")


def fused_signal_counts(findings: DataFrame) -> DataFrame:
    """How often each rule contributed to a fused finding; single signals are not shown."""
    several = F.aggregate(F.map_values("fused_signals"), lit(0).cast("bigint"), lambda a, n: a + n) > 1
    return findings.where(several).select("id", F.explode("fused_signals").alias("signal", "n"))


def correlation_summary(
    collections: DataFrame, actor_of: DataFrame
) -> DataFrame:
    """Actor count, whether a probe was used, and the flat collector addresses.

    ``collections``: collection_id and ``collector_ip``, a map of interface -> addresses.
    """
    counts = actor_of.groupBy("collection_id").agg(F.count_distinct("actor").alias("actor_count"))
    return collections.join(counts, "collection_id", "left").select(
        "collection_id",
        F.coalesce("actor_count", lit(0)).alias("actor_count"),
        c("collector_ip").isNotNull().alias("probe"),
        F.coalesce(
            F.flatten(F.map_values("collector_ip")), F.array().cast("array<string>")
        ).alias("collector_ips"),
    )
