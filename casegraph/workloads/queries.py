"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.functions.events import rule_view
from casegraph.operators import graph_metrics as gm
from casegraph.operators.fuzzy import fuzzy_pairs
from casegraph.operators.linking import time_window_links
from casegraph.operators.nearest import nearest_join
from casegraph.operators.reassembly import dump_chunks, reassemble
from casegraph.plans import correlate as co
from casegraph.plans import reports
from casegraph.plans.detect import Findings, RuleSet, detect, row_hits
from casegraph.plans.fuse import cluster_members, fuse
from casegraph.plans.normalize_snapshots import (
    normalize_access,
    normalize_network,
    normalize_registry,
    normalize_tasks,
    tag_probe,
)
from casegraph.plans.normalize_windows import normalize_log
from casegraph.plans.rules_row import web_rules
from casegraph.plans.rules_set import login_attempts
from casegraph.session import cut_lineage, discard, release, stored
from casegraph.sources.integrity import verify_integrity
from casegraph.sources.selection import log_coverage, merge_new, select_events
from casegraph.sources.weblogs import lines_since, parse_access
from casegraph.workloads import adapters as ad

c = F.col
lit = F.lit
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def found(events: DataFrame, *rule_ids: str) -> DataFrame:
    """Findings of some rules."""
    return detect(events, RuleSet.of(*rule_ids)).whole().findings


# ------------------------------------------------------------------ sources
@query
def channel_counts(spark, sf):
    """Events per channel, largest first."""
    events = ad.table(spark, sf, "events").withColumnRenamed("event_type", "channel")
    return reports.channel_counts(events)


@query
def lookback_filter(spark, sf):
    """The last 48 hours of a log."""
    events = ad.table(spark, sf, "events").select("event_type", "ts")
    recent = select_events(events, "ts", lit("2024-01-20 00:00:00").cast("timestamp"))
    return recent.groupBy("event_type").agg(F.count(lit(1)).alias("n"), micros(F.min("ts")).alias("first_us"))


@query
def merged_new_events(spark, sf):
    """Critical events added to a log unless (time, id) is there already."""
    orders = ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    base = orders.where(c("o_orderpriority") == "1-URGENT")
    extra = orders.where(c("o_orderstatus") == "F")
    return merge_new(base, extra, ["o_orderdate", "o_custkey"]).select("o_orderkey", "o_orderstatus")


@query
def oldest_per_log(spark, sf):
    """Oldest event per log."""
    out = log_coverage(ad.table(spark, sf, "events"), "ts", ["event_type"])
    return out.select("event_type", micros(c("oldest")).alias("oldest_us"))


@query
def access_log_lines(spark, sf):
    """Access-log text to events; broken lines are dropped."""
    rows = parse_access(ad.access_lines(spark, sf)).withColumn("collection_id", lit("web"))
    events = normalize_access(rows)
    return events.select(
        "ord",
        micros(c("timestamp")).alias("at_us"),
        c("source.ip").alias("ip"),
        c("http.request_method").alias("method"),
        c("http.response_status_code").alias("status"),
        c("http.user_agent").alias("agent"),
        c("url.path").alias("path"),
    )


@query
def access_lines_since(spark, sf):
    """Lines dated on or after a day."""
    lines = lines_since(ad.access_lines(spark, sf), "access", lit("2024-01-15 00:00:00").cast("timestamp"))
    return lines.agg(F.count(lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@query
def file_integrity(spark, sf):
    """Table files against a manifest in which one hash is wrong."""
    from casegraph.sources.integrity import file_hashes

    manifest = file_hashes(spark, f"{sf}/*.parquet").select(
        "file_name",
        F.when(c("file_name") == "part.parquet", lit("0" * 64)).otherwise(F.upper("actual")).alias("declared"),
    )
    return verify_integrity(spark, f"{sf}/*.parquet", manifest)


# ------------------------------------------------------------------ normalisation
@query
def normalized_processes(spark, sf):
    """Process-create records."""
    e = normalize_log(ad.sysmon_process_raw(spark, sf), "sysmon")
    return e.select(
        "ord",
        micros(c("event.created")).alias("created_us"),
        c("event.action").alias("action"),
        c("event.severity").alias("severity"),
        c("user.name").alias("user_name"),
        c("user.domain").alias("user_domain"),
        c("process.name").alias("process"),
        c("process.pid").alias("pid"),
        c("process.command_line").alias("command"),
        c("process.args_count").alias("args_count"),
        c("process.entity_id").alias("guid"),
        c("process.parent.name").alias("parent"),
        c("process.parent.entity_id").alias("parent_guid"),
        c("logon.id").alias("logon_id"),
    )


@query
def normalized_files(spark, sf):
    """File-create and file-delete records."""
    e = normalize_log(ad.sysmon_file_raw(spark, sf), "sysmon")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("file.path").alias("path"),
        c("file.name").alias("name"),
        c("logon.id").alias("logon_id"),
    )


@query
def normalized_security(spark, sf):
    """Logons, failed logons, accounts and groups."""
    e = normalize_log(ad.security_raw(spark, sf), "security")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("user.name").alias("user_name"),
        c("user.domain").alias("user_domain"),
        c("user.id").alias("user_id"),
        c("source.ip").alias("ip"),
        c("process.pid").alias("pid"),
        c("logon.id").alias("logon_id"),
        c("logon.type").alias("logon_type"),
        c("group.name").alias("group_name"),
        c("group.member_id").alias("member_id"),
    )


@query
def normalized_wmi(spark, sf):
    """Subscriptions, with the security id rebuilt from its bytes."""
    e = normalize_log(ad.wmi_raw(spark, sf), "wmi")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("user.id").alias("sid"),
        c("process.name").alias("consumer_type"),
        c("process.entity_id").alias("consumer_name"),
    )


@query
def normalized_network(spark, sf):
    """TCP connections and ARP entries."""
    e = normalize_network(ad.network_raw(spark, sf))
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("source.ip").alias("src_ip"),
        c("source.port").alias("src_port"),
        c("destination.port").alias("dst_port"),
        c("process.pid").alias("pid"),
        c("process.name").alias("process"),
        c("host.mac").alias("mac"),
    )


@query
def normalized_tasks(spark, sf):
    """Scheduled tasks, the action split into executable and arguments."""
    e = normalize_tasks(ad.task_raw(spark, sf))
    return e.select(
        "ord",
        c("event.code").alias("task"),
        micros(c("timestamp")).alias("last_run_us"),
        c("process.executable").alias("executable"),
        F.array_join("process.args", " ").alias("args"),
        c("process.command_line").alias("command"),
    )


@query
def normalized_registry(spark, sf):
    """Registry values and service keys."""
    e = normalize_registry(ad.registry_raw(spark, sf))
    return e.select(
        "ord",
        c("registry.path").alias("path"),
        c("registry.data").alias("data"),
        c("process.executable").alias("executable"),
        c("process.args_count").alias("args_count"),
    )


@query
def probe_tags(spark, sf):
    """Connections that touch a collector address."""
    events = normalize_network(ad.network_raw(spark, sf))
    probes = ad.table(spark, sf, "region").agg(
        F.array_append(
            F.collect_list(F.concat(lit("172.16.0."), c("r_regionkey"))), lit("169.254.1.1")
        ).alias("ips")
    ).select(lit("host").alias("collection_id"), "ips")
    tagged = tag_probe(events, probes)
    return tagged.where("is_probe").select("ord", c("destination.ip").alias("dst_ip"))


@query
def reassembled_requests(spark, sf):
    """Requests put together from interleaved connections."""
    requests = reassemble(dump_chunks(ad.traffic_entries(spark, sf)))
    return requests.select(
        "client", "method", "path", F.octet_length("body").cast("bigint").alias("body_bytes"), F.md5("body").alias("body_md5")
    )


# ------------------------------------------------------------------ expressions
@query
def url_fields(spark, sf):
    """Effective URL, file name and command of a request."""
    view = rule_view(ad.web_events(spark, sf, attack=True))
    return view.select(
        "ord", "url", x.url_file_name(c("url")).alias("file_name"), x.url_command(c("url")).alias("command")
    )


@query
def body_commands(spark, sf):
    """suspicious command in a form body."""
    view = rule_view(ad.web_events(spark, sf, attack=True))
    return view.where(c("body").isNotNull()).select("ord", x.body_command(c("body")).alias("command"))


# ------------------------------------------------------------------ row rules
def row_listing(findings: DataFrame) -> DataFrame:
    at = F.when(c("ord.phase") == 0, c("ord.a")).otherwise(c("ord.b"))
    return findings.select(
        "rule_id", at.alias("event_ord"), "severity", "confidence", "technique_id", "kill_chain_phase"
    )


@query
def web_row_rules(spark, sf):
    """The eight request rules in one scan."""
    return row_listing(
        found(
            ad.web_events(spark, sf, attack=True),
            "WEB_SQLI_001",
            "WEB_LFI_001",
            "WEB_CMDI_001",
            "WEB_XSS_001",
            "WEB_WEBSHELL_UPLOAD_001",
            "WEB_WEBSHELL_EXEC_001",
            "WEB_MALICIOUS_UPLOAD_001",
            "WEB_WEBSHELL_EXEC_002",
        )
    )


@query
def process_row_rules(spark, sf):
    """The five process rules and the command-line rule over process-create records."""
    events = normalize_log(ad.sysmon_process_raw(spark, sf), "sysmon")
    return row_listing(
        found(
            events,
            "PROC_SUSPICIOUS_001",
            "PROC_WEBSHELL_CHILD_001",
            "WIN_SUSPICIOUS_CMDLINE_001",
            "WIN_CMD_USER_CREATION_001",
            "WIN_CMD_PERSISTENCE_ARTIFACT_001",
            "PROC_SUSPICIOUS_CMDLINE_001",
        )
    )


@query
def network_row_rules(spark, sf):
    """The six connection rules."""
    events = normalize_network(ad.network_raw(spark, sf))
    return row_listing(
        found(
            events,
            "NET_SUSPICIOUS_LISTENER_001",
            "NET_SUSPICIOUS_PORT_001",
            "NET_REVERSE_SHELL_001",
            "NET_SUSPICIOUS_OUTBOUND_001",
            "NET_SUSPICIOUS_SSH_001",
            "NET_WEBSERVER_INBOUND_001",
        )
    )


@query
def registry_row_rules(spark, sf):
    """The three registry rules."""
    events = normalize_registry(ad.registry_raw(spark, sf))
    return row_listing(
        found(events, "REG_RUNKEY_001", "REG_DEFENDER_EXCLUSION_001", "REG_SUSPICIOUS_SERVICE_001")
    )


@query
def task_row_rules(spark, sf):
    """The scheduled-task rules that look at task snapshots."""
    events = normalize_tasks(ad.task_raw(spark, sf))
    out = found(
        events,
        "TASK_WEBROOT_EXEC_001",
        "TASK_PS_HIDDEN_001",
        "TASK_MASQUERADE_001",
        "TASK_LOLBIN_001",
        "TASK_NON_SYSTEM_EXEC_001",
    )
    return row_listing(out).withColumn("event_ord", F.shiftright("event_ord", 32))


@query
def account_row_rules(spark, sf):
    """Account creation, privileged groups and remote logons."""
    events = normalize_log(ad.security_raw(spark, sf), "security")
    return row_listing(
        found(events, "WIN_USER_CREATED_001", "WIN_GROUP_ADD_001", "WIN_REMOTE_LOGIN_001")
    )


@query
def file_row_rules(spark, sf):
    """File drops and deletions."""
    events = normalize_log(ad.sysmon_file_raw(spark, sf), "sysmon")
    return row_listing(
        found(
            events,
            "SYS_SUSPICIOUS_FILE_DROP_001",
            "WIN_SENSITIVE_FILE_DELETE_001",
            "WIN_SYSTEM_FILE_DELETE_001",
        )
    )


@query
def wmi_row_rules(spark, sf):
    """WMI subscriptions."""
    return row_listing(found(normalize_log(ad.wmi_raw(spark, sf), "wmi"), "WMI_SUBSCRIPTION_001"))


@query
def html_rules(spark, sf):
    """The pattern rules over whole page texts."""
    pages = ad.table(spark, sf, "pages").select(
        lit("web").alias("collection_id"),
        lit("web_logs").alias("channel"),
        c("page_id").alias("id"),
        F.lower("html").alias("url"),
        lit(True).alias("has_url"),
    )
    rules = [r for r in web_rules() if r.rule_id in ("WEB_SQLI_001", "WEB_LFI_001", "WEB_CMDI_001", "WEB_XSS_001")]
    names = F.array(*[lit(r.rule_id) for r in rules])
    return row_hits(pages, rules).select(F.get(names, c("rule_at")).alias("rule_id"), c("id").alias("page_id"))


@query
def rule_contracts(spark, sf):
    """Contracts of process findings, the session contract of the logon included."""
    events = normalize_log(ad.sysmon_process_raw(spark, sf), "sysmon")
    findings = found(events, "PROC_WEBSHELL_CHILD_001", "WIN_CMD_USER_CREATION_001", "WIN_CMD_PERSISTENCE_ARTIFACT_001")
    both = [
        findings.select("rule_id", c("ord.a").alias("event_ord"), lit(role).alias("role"), F.explode(role).alias("cap"))
        for role in ("requires", "provides")
    ]
    return both[0].unionByName(both[1]).select(
        "rule_id", "event_ord", "role", c("cap.name").alias("cap"), c("cap.values")[0].alias("value")
    )


@query
def resolved_logons(spark, sf):
    """Logon ids of deletions, their own or that of the process-create event."""
    files = normalize_log(ad.sysmon_file_raw(spark, sf), "sysmon")
    creates = ad.table(spark, sf, "orders").select(
        lit("host").alias("collection_id"),
        c("o_orderkey").alias("ord"),
        lit("2024-01-01T00:00:00Z").alias("time_created"),
        lit(1).alias("event_id"),
        lit("process created").alias("message"),
        ad.data_map(
            ProcessGuid=F.concat(lit("{P-"), c("o_orderkey"), lit("}")),
            LogonId=F.concat(lit("0x"), F.hex(c("o_custkey") + 1)),
        ).alias("event_data"),
    )
    events = files.unionByName(normalize_log(creates, "sysmon"))
    findings = found(events, "WIN_SENSITIVE_FILE_DELETE_001")
    return findings.select(c("ord.a").alias("event_ord"), "logon_id")


# ------------------------------------------------------------------ set rules
def group_listing(findings: DataFrame, *extra: str) -> DataFrame:
    return findings.select(
        "rule_id",
        *[c("extra")[name].alias(name) for name in extra],
        "event_count",
        "severity",
        "confidence",
        micros(c("timestamp")).alias("first_us"),
        "description",
    )


@query
def web_brute_force(spark, sf):
    """WEB_BRUTE_FORCE_001."""
    return group_listing(found(ad.web_events(spark, sf), "WEB_BRUTE_FORCE_001"), "source_ip", "target_url")


@query
def web_recon_scan(spark, sf):
    """WEB_RECON_SCAN_001, with the first five URLs."""
    return group_listing(found(ad.web_events(spark, sf), "WEB_RECON_SCAN_001"), "source_ip", "sample_urls")


@query
def web_scanners(spark, sf):
    """WEB_SCANNER_UA_001."""
    return group_listing(found(ad.web_events(spark, sf), "WEB_SCANNER_UA_001"), "tool", "source_ip")


@query
def web_login_after_failures(spark, sf):
    """WEB_LOGIN_SUCCESS_AFTER_BF_001."""
    return group_listing(
        found(ad.web_events(spark, sf), "WEB_LOGIN_SUCCESS_AFTER_BF_001"), "source_ip", "failed_count"
    )


@query
def login_outcomes(spark, sf):
    """The outcome of each form login: the address's next request decides."""
    out = login_attempts(rule_view(ad.web_events(spark, sf)))
    return out.select("ord", "src_ip", "succeeded")


@query
def logon_brute_force(spark, sf):
    """WIN_BRUTE_FORCE_001."""
    events = normalize_log(ad.security_raw(spark, sf), "security")
    return found(events, "WIN_BRUTE_FORCE_001").select(
        c("extra")["target_user"].alias("target_user"), "event_count", "confidence", "description"
    )


@query
def mass_deletion(spark, sf):
    """WIN_MASS_FILE_DELETE_001."""
    events = normalize_log(ad.sysmon_file_raw(spark, sf), "sysmon")
    return found(events, "WIN_MASS_FILE_DELETE_001").select(
        c("extra")["actor_key"].alias("actor_key"),
        c("extra")["file_count"].alias("file_count"),
        c("extra")["window_seconds"].alias("window_seconds"),
        micros(c("facts.event_time")).alias("first_us"),
    )


@query
def arp_poisoning(spark, sf):
    """NET_ARP_POISONING_001."""
    events = normalize_network(ad.network_raw(spark, sf))
    return found(events, "NET_ARP_POISONING_001").select(c("extra")["mac"].alias("mac"), "event_count", "description")


@query
def script_blocks(spark, sf):
    """PS_ORPHANED_SCRIPTBLOCK_001 and PS_CONFIRMED_SUSPICIOUS_EXEC_001."""
    events = normalize_log(ad.script_raw(spark, sf), "powershell")
    out = found(events, "PS_ORPHANED_SCRIPTBLOCK_001", "PS_CONFIRMED_SUSPICIOUS_EXEC_001")
    return out.select("rule_id", c("extra")["script_block_id"].alias("block_id"), "event_count", "severity")


@query
def finding_triggers(spark, sf):
    """The events behind web brute-force findings."""
    result = detect(cut_lineage(ad.web_events(spark, sf)), RuleSet.of("WEB_BRUTE_FORCE_001")).whole()
    ip = result.findings.select(c("id").alias("finding_id"), c("extra")["source_ip"].alias("source_ip"))
    return result.triggers.join(ip, "finding_id").select("source_ip", c("value").alias("url"), c("ord").alias("event_ord"))


# ------------------------------------------------------------------ joins and links
@query
def nearest_view(spark, sf):
    """The nearest view of the same user within ten minutes of each error."""
    events = ad.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where(c("event_type") == "error").drop("event_type")
    views = events.where(c("event_type") == "view").withColumn("view_id", c("event_id"))
    out = nearest_join(errors, views, ["user_id"], "ts", "view_id", "event_id", 600)
    return out.select("event_id", c("nearest.value").alias("view_id"), c("nearest.gap_us").alias("gap_us"))


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = events.select(
        c("user_id").cast("string").alias("key"),
        F.lpad(c("event_id").cast("string"), 12, "0").alias("id"),
        c("ts").alias("t"),
        "event_type",
    )
    given = base.where(c("event_type") == "signup").drop("event_type")
    asked = base.where(c("event_type") == "purchase").drop("event_type").withColumn(
        "window_s", lit(fv.LINK_WINDOW_SECONDS)
    )
    return given, asked


@query
def contract_ranges(spark, sf):
    """Signups provide, purchases of the same user within six hours require."""
    links = time_window_links(*_sides(ad.table(spark, sf, "events")), ["key"])
    return links.ranges.select(
        "target", "n_sources", micros(c("first_time")).alias("first_us"), micros(c("last_time")).alias("last_us")
    )


@query
def lineage_ranges(spark, sf):
    """Process findings under the process that started them."""
    events = normalize_log(ad.sysmon_process_raw(spark, sf), "sysmon")
    view = rule_view(events).select(
        "collection_id",
        F.lpad(c("ord").cast("string"), 12, "0").alias("id"),
        F.struct("event_time", "guid", "pid", "parent_guid", "parent_pid").alias("facts"),
    )
    links = time_window_links(*co.lineage_sides(view), co.LINEAGE_KEYS, untimed="both")
    return links.ranges.select("process_key", "target", "n_sources")


@query
def fuzzy_passages(spark, sf):
    """Passages against their edited copies and all conversation turns, ratio 0.9."""
    passages = ad.table(spark, sf, "benchmark").select(lit("t").alias("g"), "item_id", "text")
    # Even passages get a small edit, odd ones have every vowel replaced.
    edited = passages.withColumn(
        "text",
        F.when(c("item_id") % 2 == 0, F.concat(F.regexp_replace("text", "^(.)(.)", "$2$1"), lit(" end"))).otherwise(
            F.translate("text", "aeiou", "xyxyx")
        ),
    )
    turns = ad.table(spark, sf, "conversations").select(lit("t").alias("g"), "text")
    pairs = fuzzy_pairs(passages.drop("item_id"), edited.drop("item_id").unionByName(turns), ["g"])
    return pairs.select(
        F.md5("left_text").alias("passage"), F.md5("right_text").alias("other"), F.round("score", 6).alias("score")
    )


# ------------------------------------------------------------------ fusion
def document_findings(spark: SparkSession, sf: str) -> Findings:
    """Documents as findings: copies share one key, source and length another."""
    docs = ad.table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang", F.md5("text").alias("h"))
    severity = F.get(F.array(*[lit(s) for s in fv.SEVERITIES]), (c("doc_id") % 5).cast("int"))
    from casegraph.schemas import FINDING_DDL, TRIGGER_DDL
    from pyspark.sql.types import StructType

    values = {
        "collection_id": lit("docs"),
        "channel": lit("docs"),
        "id": F.lpad(c("doc_id").cast("string"), 12, "0"),
        "ord": F.struct(lit("docs"), lit(0), c("doc_id"), lit(0)),
        "rule_id": F.concat(lit("LANG_"), c("lang")),
        "rule_name": c("lang"),
        "rule_type": lit("per_event"),
        "fusion_key": F.array(
            F.array(lit("text"), c("h")), F.array(lit("size"), c("source"), c("n_chars").cast("string"))
        ),
        "severity": severity,
        "confidence": (c("doc_id") % 7) / 10,
        "tags": F.array(c("lang")),
        "source": c("source"),
        "event_count": lit(1),
        "extra": F.create_map(lit("logon_id"), F.concat(lit("0x"), F.hex(c("n_chars")))),
        "is_probe": lit(False),
    }
    schema = StructType.fromDDL(FINDING_DDL)
    findings = docs.select(
        *[values.get(f.name, lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    findings = findings.withColumns(
        {
            "requires": F.coalesce("requires", F.array().cast(schema["requires"].dataType)),
            "provides": F.coalesce("provides", F.array().cast(schema["provides"].dataType)),
            "entities": F.create_map().cast("map<string,string>"),
        }
    )
    kinds = {f.name: f.dataType for f in StructType.fromDDL(TRIGGER_DDL).fields}
    triggers = findings.select(
        "collection_id", "channel", c("id").alias("finding_id"), c("id").alias("event_id"),
        lit(0).cast(kinds["ord"]).alias("ord"), x.null_string().alias("value"),
    )
    return Findings(findings, triggers)


@query
def fused_components(spark, sf):
    """Documents joined through shared keys; only those that share one."""
    members = cluster_members(document_findings(spark, sf).findings)
    return members.select("id", "cluster")


@query
def fused_findings(spark, sf):
    """Merged clusters with their base, sums and conflicts."""
    fused = fuse(document_findings(spark, sf))
    return fused.findings.select(
        "id",
        "members",
        "severity",
        "confidence",
        "event_count",
        F.array_join(F.array_sort("tags"), ",").alias("tags"),
        "logon_id_conflict",
        "logon_id",
    )


# ------------------------------------------------------------------ identities, actors
def event_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as findings with identities that partly disagree about the address."""
    rows = ad.web_columns(ad.table(spark, sf, "events"))
    user, k = c("user_id"), c("k")
    return rows.select(
        lit("web").alias("collection_id"),
        c("event_id").cast("string").alias("id"),
        F.when(c("event_type") == "error", lit("NET_WEBSERVER_INBOUND_001")).otherwise(lit("R")).alias("rule_id"),
        F.struct(
            c("ts").alias("event_time"),
            F.when(k % 9 == 0, c("ip")).when(k % 9 == 1, lit("-")).alias("ip"),
            F.when(k % 3 == 0, F.concat(lit("g"), user, lit("-"), k)).alias("guid"),
            (user * 100 + k).alias("pid"),
        ).alias("facts"),
        F.when(k % 4 == 0, F.concat(lit("s-1-5-"), F.when(user % 10 == 0, lit(18)).otherwise(user + 100))).alias("user_sid"),
        F.when(k % 4 == 1, F.concat(lit("s-1-5-"), user + 100)).alias("member_sid"),
        F.when(k % 5 == 0, F.concat(lit("0x"), F.lower(F.hex(user * 128 + k)))).alias("logon_key"),
    )


@query
def identity_groups(spark, sf):
    """Identity groups, generic ids and address conflicts left out."""
    return co.identity_groups(event_nodes(spark, sf)).select("kind", "key", "n")


@query
def attack_actors(spark, sf):
    """Web and process telemetry to actors."""
    web = ad.web_events(spark, sf, attack=True)
    processes = normalize_log(ad.sysmon_process_raw(spark, sf), "sysmon").withColumn("collection_id", lit("web"))
    events = stored(web.unionByName(processes))
    fused = fuse(detect(events).whole())
    release(spark)
    # Only the events of single nodes, which are not asked for here, would read the events again.
    graph = co.correlate(fused, events)
    discard(events)
    nodes = stored(graph.nodes)
    release(spark)
    return reports.actor_summary(nodes).select("actor", "nodes", "label", "max_severity", "phases")


# ------------------------------------------------------------------ graph measures
def place_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as a graph; nations also follow one another."""
    region = ad.table(spark, sf, "region").select(F.concat(lit("r"), c("r_regionkey")).alias("id"), lit("reconnaissance").alias("phase"))
    nation = ad.table(spark, sf, "nation")
    nations = nation.select(F.concat(lit("n"), c("n_nationkey")).alias("id"), lit("delivery").alias("phase"))
    customer = ad.table(spark, sf, "customer")
    customers = customer.select(
        F.concat(lit("c"), c("c_custkey")).alias("id"),
        F.when(c("c_mktsegment") == "BUILDING", lit("installation")).otherwise(lit("exploitation")).alias("phase"),
    )
    edges = nation.select(F.concat(lit("r"), c("n_regionkey")).alias("source"), F.concat(lit("n"), c("n_nationkey")).alias("target"))
    chain = nation.where(c("n_nationkey") >= 5).select(
        F.concat(lit("n"), c("n_nationkey") - 5).alias("source"), F.concat(lit("n"), c("n_nationkey")).alias("target")
    )
    leaf = customer.select(F.concat(lit("n"), c("c_nationkey")).alias("source"), F.concat(lit("c"), c("c_custkey")).alias("target"))
    return region.unionByName(nations).unionByName(customers), edges.unionByName(chain).unionByName(leaf)


@query
def longest_path_rank(spark, sf):
    """G10."""
    return gm.longest_path_rank(*place_graph(spark, sf))


@query
def lane_counts(spark, sf):
    """G11."""
    nodes, edges = place_graph(spark, sf)
    ranked = gm.longest_path_rank(nodes, edges).join(nodes, "id")
    return gm.lane_counts(ranked)


@query
def induced_subgraph(spark, sf):
    """G12."""
    nodes, edges = place_graph(spark, sf)
    return gm.subgraph(nodes, edges, c("phase") != "exploitation")[1].select("source", "target")


@query
def closed_neighbourhood(spark, sf):
    """G13."""
    return gm.neighbourhood(place_graph(spark, sf)[1], lit("n7"))


# ------------------------------------------------------------------ reports
def order_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings of their customer's host."""
    key = c("o_orderkey")
    return ad.table(spark, sf, "orders").select(
        key.cast("string").alias("id"),
        F.concat(lit("host"), c("o_custkey") % 100).alias("host"),
        c("o_custkey").alias("custkey"),
        c("o_orderdate").alias("timestamp"),
        F.get(F.array(*[lit(s) for s in fv.SEVERITIES]), (key % 4).cast("int")).alias("severity"),
        F.get(F.array(*[lit(p) for p in fv.KILL_CHAIN_PHASES]), (key % 7).cast("int")).alias("kill_chain_phase"),
        F.concat(lit("Rule "), c("o_orderpriority")).alias("rule_name"),
        c("o_orderstatus").alias("source"),
        lit("T1059").alias("technique_id"),
        F.concat(lit("order of customer "), c("o_custkey")).alias("description"),
        F.array(F.lower("o_orderpriority"), lit("order")).alias("tags"),
    )


@query
def finding_summary(spark, sf):
    """Findings and highest severity per host."""
    return reports.finding_summary(order_findings(spark, sf), "host")


@query
def sticky_severity(spark, sf):
    """R2: the stored severity only ever rises."""
    stored = ad.table(spark, sf, "customer").select(
        c("c_custkey").alias("custkey"),
        F.when(c("c_custkey") % 3 == 0, lit("medium")).when(c("c_custkey") % 3 == 1, lit("critical")).alias("max_severity"),
    )
    return reports.sticky_severity(stored, order_findings(spark, sf), "custkey")


@query
def host_rollup(spark, sf):
    """Latest scan and maxima per host."""
    scans = order_findings(spark, sf).select(
        "host",
        c("id").alias("collection_id"),
        F.concat(c("timestamp").cast("date").cast("string"), lit("#"), F.lpad("id", 12, "0")).alias("collected_at"),
        c("severity").alias("max_severity"),
        (c("custkey") % 37).alias("finding_count"),
        F.when(c("custkey") % 5 != 0, c("custkey") % 11).alias("actor_count"),
    )
    return reports.host_rollup(scans, "HOST1").select(
        "host", "latest_scan", "max_severity", "max_findings", "max_actors", "total_scans"
    )


@query
def finding_facets(spark, sf):
    """Severities and phases present."""
    return reports.facets(order_findings(spark, sf), "severity", "kill_chain_phase")


@query
def finding_search(spark, sf):
    """Severity set and text over fields and tags."""
    hits = reports.search_findings(order_findings(spark, sf), " URGENT ", severities=("high", "medium"))
    return hits.select("id", "severity")


@query
def actor_summary(spark, sf):
    """Per customer the address of the worst finding, severity and phase span."""
    findings = order_findings(spark, sf)
    nodes = findings.select(
        lit("x").alias("collection_id"),
        F.lpad("id", 12, "0").alias("id"),
        c("custkey").cast("int").alias("actor"),
        c("timestamp").alias("event_time"),
        F.struct(
            "severity",
            c("kill_chain_phase").alias("kill_chain"),
            F.when(c("id").cast("bigint") % 3 == 0, F.concat(lit("10.0.0."), c("id").cast("bigint") % 90)).alias("source_ip"),
        ).alias("fields"),
    )
    return reports.actor_summary(nodes).select("actor", "nodes", "label", "max_severity", "phases")


@query
def alert_listing(spark, sf):
    """Flat listing of web findings, most severe first."""
    rules = RuleSet.of("WEB_BRUTE_FORCE_001", "WEB_RECON_SCAN_001")
    findings = detect(cut_lineage(ad.web_events(spark, sf)), rules).whole().findings
    return reports.findings_listing(findings).select(
        "rule_id", "severity", "description", F.array_join("tags", ",").alias("tags"), "event_count"
    )


@query
def flattened_events(spark, sf):
    """Nested events as dotted names and values."""
    events = ad.web_events(spark, sf).drop("collection_id", "channel", "ord", "is_probe")
    return (
        reports.flatten_events(events, ("id",))
        .groupBy("name")
        .agg(F.count(lit(1)).alias("n"), F.count_distinct("value").alias("values"))
    )
