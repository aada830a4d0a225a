"""Building normalised event rows, and the flat view of them that the rules read."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegraph.functions import exprs as x
from casegraph.schemas import EVENT_DDL, EVENT_STRUCTS


@cache
def event_schema() -> StructType:
    return StructType.fromDDL(EVENT_DDL)


#: Structs whose presence the rules test.
TESTED = ["user", "process", "network", "destination", "registry", "http", "url", "file", "group"]

# A parser maps dotted member paths to columns, e.g. {"event.action": lit("x"), ...}.
Parser = dict[str, Column]


def _leaf(variants: list[tuple[Column | None, Parser]], path: str) -> Column | None:
    """CASE over the parsers that set ``path``."""
    used = [(cond, parser[path]) for cond, parser in variants if path in parser]
    if not used:
        return None
    if len(used) == 1 and used[0][0] is None:
        return used[0][1]
    merged: list[tuple[list[Column], Column]] = []
    for cond, value in used:
        # Neighbours that set the same column share a branch: less code, which stays small enough to be compiled.
        if merged and merged[-1][1] is value:
            merged[-1][0].append(cond)
        else:
            merged.append(([cond], value))
    return reduce(
        lambda acc, item: acc.when(*item) if acc is not None else F.when(*item),
        [(x.any_of(conds), value) for conds, value in merged],
        None,
    )


def _struct(
    variants: list[tuple[Column | None, Parser]], struct: StructType, prefix: str
) -> Column:
    members = []
    for field in struct.fields:
        path = f"{prefix}.{field.name}"
        if isinstance(field.dataType, StructType):
            value = _presence(variants, field.dataType, path)
        else:
            value = _leaf(variants, path)
            value = F.lit(None) if value is None else value
        members.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*members)


def _presence(
    variants: list[tuple[Column | None, Parser]], struct: StructType, prefix: str
) -> Column:
    """The struct where some parser fills it, null elsewhere: rules test for presence."""
    used = [
        (cond, parser)
        for cond, parser in variants
        if any(p == prefix or p.startswith(f"{prefix}.") for p in parser)
    ]
    if not used:
        return F.lit(None).cast(struct)
    body = _struct(used, struct, prefix)
    if any(cond is None for cond, _ in used):
        return body
    return F.when(x.any_of([cond for cond, _ in used]), body)


def event_columns(variants: list[tuple[Column | None, Parser]]) -> list[Column]:
    """Event members as columns; each variant is (condition, parser)."""
    timestamp = _leaf(variants, "timestamp")
    timestamp = F.lit(None) if timestamp is None else timestamp
    return [timestamp.cast("timestamp").alias("timestamp")] + [
        _presence(variants, event_schema()[name].dataType, name).alias(name) for name in EVENT_STRUCTS
    ]


def _single_members(variants: list[tuple[Column | None, Parser]]) -> list[Column]:
    """Each member as a column named by its path, and whether the structs are there whose presence rules test."""

    def members(struct: StructType, prefix: str) -> list[Column]:
        found = []
        for field in struct.fields:
            path = f"{prefix}{field.name}"
            if isinstance(field.dataType, StructType):
                found += members(field.dataType, f"{path}.")
            else:
                value = _leaf(variants, path)
                value = F.lit(None) if value is None else value
                found.append(value.cast(field.dataType).alias(path))
        return found

    structs = StructType([f for f in event_schema().fields if f.name == "timestamp" or f.name in EVENT_STRUCTS])
    return members(structs, "") + [
        _presence(variants, event_schema()[name].dataType, name).isNotNull().alias(f"has_{name}") for name in TESTED
    ]


def build_events(
    raw: DataFrame,
    channel: str,
    variants: list[tuple[Column | None, Parser]],
    original: Column,
) -> DataFrame:
    """One projection from raw rows (``collection_id``, ``ord``, …) to the event schema."""
    event_id = x.stable_id(F.col("collection_id"), F.lit(channel), F.col("ord"), original)
    keys = [
        F.col("collection_id"),
        F.lit(channel).alias("channel"),
        F.col("ord").cast("bigint").alias("ord"),
        event_id.alias("id"),
    ]
    is_probe = F.lit(False).alias("is_probe")
    events = raw.select(*keys, *event_columns(variants), is_probe)
    # Spark computes all members of a struct within a condition for one that is read, so the flat view of
    # these rows reads them one by one.
    events.single_members = lambda: raw.select(*keys, *_single_members(variants), is_probe)
    return events


def rule_view(events: DataFrame) -> DataFrame:
    """The members the rules read, flat, so that nested column pruning reaches the scan.

    Fewer than 100 columns also keeps whole-stage code generation on.
    """
    c = F.col
    empty = F.lit("")
    # Events as they were built; any step in between, such as storing them, makes another frame.
    single = getattr(events, "single_members", None)

    def m(path: str) -> Column:
        return c(path) if single is None else c(f"`{path}`")

    def has(name: str) -> Column:
        return (c(name).isNotNull() if single is None else c(f"has_{name}")).alias(f"has_{name}")

    return (events if single is None else single()).select(
        c("collection_id"),
        c("channel"),
        c("ord"),
        c("id"),
        # The time used for ordering and windows.
        F.coalesce(c("timestamp"), m("event.created")).alias("event_time"),
        m("event.created").alias("created"),
        F.coalesce(m("event.action"), empty).alias("action"),
        m("event.dataset").alias("dataset"),
        F.coalesce(m("event.code"), empty).alias("code"),
        F.coalesce(m("event.original").cast("string"), empty).alias("original"),
        has("user"),
        F.coalesce(F.lower(m("user.name")), empty).alias("user_name"),
        m("user.name").alias("raw_user_name"),
        m("user.domain").alias("user_domain"),
        m("user.id").alias("user_id"),
        has("process"),
        F.coalesce(m("process.name"), empty).alias("process"),
        F.coalesce(m("process.executable"), empty).alias("executable"),
        m("process.args").alias("args"),
        x.non_empty(m("process.command_line")).alias("command"),
        m("process.pid").alias("pid"),
        x.non_empty(m("process.entity_id")).alias("guid"),
        F.coalesce(F.lower(m("process.parent.name")), empty).alias("parent"),
        m("process.parent.pid").alias("parent_pid"),
        x.non_empty(m("process.parent.entity_id")).alias("parent_guid"),
        m("process.parent.command_line").alias("parent_command"),
        has("network"),
        m("source.ip").alias("src_ip"),
        F.nullif(m("source.port"), F.lit(0)).alias("src_port"),
        has("destination"),
        x.non_empty(m("destination.ip")).alias("dst_ip"),
        F.nullif(m("destination.port"), F.lit(0)).alias("dst_port"),
        m("host.ip").alias("host_ip"),
        m("host.mac").alias("host_mac"),
        F.coalesce(x.non_empty(m("host.name")), x.non_empty(m("winlog.computer_name"))).alias(
            "host"
        ),
        F.coalesce(m("host.hostname"), empty).alias("hostname"),
        has("registry"),
        m("registry.path").alias("registry_path"),
        m("registry.value").alias("registry_value"),
        m("registry.data").alias("registry_data"),
        m("winlog.event_id").alias("event_code"),
        m("winlog.extra").alias("winlog_extra"),
        x.non_empty(m("logon.id")).alias("own_logon_id"),
        m("logon.type").alias("logon_type"),
        has("http"),
        F.lower(m("http.request_method")).alias("method"),
        m("http.response_status_code").alias("status"),
        F.coalesce(F.lower(m("http.user_agent")), empty).alias("user_agent"),
        x.non_empty(m("http.request_body")).alias("body"),
        has("url"),
        x.effective_url(m("url.original"), m("url.path")).alias("url"),
        F.coalesce(m("url.path"), empty).alias("url_path"),
        has("file"),
        x.non_empty(m("file.path")).alias("file_path"),
        has("group"),
        F.coalesce(F.lower(m("group.name")), empty).alias("group_name"),
        x.non_empty(m("group.member_id")).alias("member_sid"),
        x.non_empty(m("powershell.script_block_id")).alias("block_id"),
        F.coalesce(m("powershell.script_block_text"), empty).alias("script"),
        m("powershell.runspace_id").alias("runspace_id"),
        F.coalesce(c("is_probe"), F.lit(False)).alias("is_probe"),
    )
