"""Registered queries of the record parsers that the general queries leave out, with their SQL.

Each adapter gives the rows of a test table the shape of raw records, over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.plans import reports
from casegraph.plans.detect import RuleSet, detect
from casegraph.plans.normalize_snapshots import normalize_error, normalize_network, normalize_processes
from casegraph.plans.normalize_windows import normalize_log
from casegraph.workloads import adapters as ad
from casegraph.workloads.oracles import arr, base, pick, q

c = F.col
lit = F.lit
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def _sql_map(entries: dict[str, str]) -> str:
    """The non-null entries of an extra map as ``k=v`` text in key order."""
    parts = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN {q(k + '=')} || {v} END" for k, v in sorted(entries.items()))
    return f"array_to_string(list_filter([{parts}], lambda e: e IS NOT NULL), ';')"


def extra_text():
    entries = F.array_sort(F.transform(F.map_entries("winlog.extra"), lambda e: F.concat(e["key"], lit("="), e["value"])))
    return F.array_join(entries, ";").alias("extra")


# ------------------------------------------------------------------ Sysmon beyond processes and files
SYSMON_CODES = ["3", "5", "7", "8", "10", "12", "13", "17", "18", "22"]
TARGETS = ["C:\\Windows\\System32\\lsass.exe", "C:\\Windows\\Explorer.exe", "D:\\Tools\\App.exe"]
PIPES = ["\\postex_1a", "\\Winsock2", "\\MSAGENT_77"]


def sysmon_other_raw(spark: SparkSession, sf: str) -> DataFrame:
    key, user = c("o_orderkey"), c("o_custkey")
    return ad.table(spark, sf, "orders").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        ad.iso(c("o_orderdate")).alias("time_created"),
        ad.pick(key % 10, SYSMON_CODES).cast("int").alias("event_id"),
        lit("event").alias("message"),
        ad.data_map(
            Image=ad.pick(key % 7, ad.IMAGES),
            ProcessId=key % 5000,
            ProcessGuid=F.concat(lit("{G-"), key, lit("}")),
            User=F.concat(lit("CORP\\User"), user),
            SourceUser=F.concat(lit("Lab\\Op"), user % 40),
            SourceImage=ad.pick(user % 7, ad.IMAGES),
            SourceProcessId=user % 3000,
            TargetImage=ad.pick(user % 3, TARGETS),
            TargetProcessId=user % 700,
            GrantedAccess=F.concat(lit("0X1F"), user % 9),
            Protocol=lit("TCP"),
            Initiated=F.when(user % 2 == 0, lit("True")).otherwise(lit("false")),
            SourceIp=F.concat(lit("10.3.0."), user % 250),
            SourcePort=user % 60000,
            DestinationIp=F.concat(lit("FE80::"), user % 90),
            DestinationPort=F.when(user % 6 == 0, lit("none")).otherwise((user % 1000).cast("string")),
            DestinationHostname=F.concat(lit(" Host"), user % 50, lit(".Example ")),
            ImageLoaded=ad.pick(key % 9, ad.FILES),
            SignatureStatus=lit("Valid"),
            TargetObject=ad.pick(user % 5, ad.REGISTRY_KEYS),
            Details=ad.pick(key % 7, ad.REGISTRY_DATA),
            PipeName=ad.pick(user % 3, PIPES),
            QueryName=F.concat(lit("Site"), user % 70, lit(".Example")),
            QueryResults=F.concat(lit("10.0.0."), user % 5, lit("; ;10.0.1."), user % 5, lit(";")),
            QueryStatus=user % 3,
        ).alias("event_data"),
    )


_SYSMON_SQL = f"""
WITH r AS (
  SELECT o_orderkey AS ord, o_custkey AS u, CAST({pick("o_orderkey % 10", SYSMON_CODES)} AS INT) AS code,
    {pick("o_orderkey % 7", ad.IMAGES)} AS image, {pick("o_custkey % 7", ad.IMAGES)} AS source_image,
    {pick("o_custkey % 3", TARGETS)} AS target, {pick("o_orderkey % 9", ad.FILES)} AS loaded,
    {pick("o_custkey % 5", ad.REGISTRY_KEYS)} AS key, {pick("o_orderkey % 7", ad.REGISTRY_DATA)} AS details,
    lower({pick("o_custkey % 3", PIPES)}) AS pipe
  FROM orders)
SELECT ord,
  CASE code WHEN 3 THEN 'network_connection' WHEN 5 THEN 'process_terminated' WHEN 7 THEN 'image_loaded'
    WHEN 8 THEN 'create_remote_thread' WHEN 10 THEN 'process_access' WHEN 12 THEN 'registry_key_created'
    WHEN 13 THEN 'registry_value_set' WHEN 17 THEN 'pipe_created' WHEN 18 THEN 'pipe_connected' ELSE 'dns_query' END AS action,
  CASE WHEN code IN (3, 7) THEN 2 WHEN code IN (5, 22) THEN 1 WHEN code = 8 THEN 4
    WHEN code = 10 THEN CASE WHEN contains(lower(target), 'lsass') THEN 5 ELSE 3 END
    WHEN code IN (17, 18) THEN
      CASE WHEN list_bool_or(list_transform({arr(fv.SUSPICIOUS_PIPES)}, lambda p: contains(pipe, p))) THEN 5 ELSE 2 END
    END AS severity,
  CASE WHEN code = 5 THEN NULL WHEN code IN (8, 10) THEN 'op' || (u % 40) ELSE 'user' || u END AS user_name,
  CASE WHEN code IN (5, 7, 8) THEN NULL WHEN code = 10 THEN 'lab' ELSE 'corp' END AS user_domain,
  CASE WHEN code IN (8, 10) THEN u % 3000 ELSE ord % 5000 END AS pid,
  CASE WHEN code IN (8, 10) THEN {base("source_image")} ELSE {base("image")} END AS process,
  '{{g-' || ord || '}}' AS guid,
  CASE WHEN code IN (8, 10) THEN {base("target")} END AS target,
  CASE WHEN code = 3 THEN CASE WHEN u % 2 = 0 THEN 'egress' ELSE 'ingress' END END AS direction,
  CASE WHEN code = 3 THEN '10.3.0.' || (u % 250) END AS src_ip,
  CASE WHEN code = 3 AND u % 6 <> 0 THEN u % 1000 END AS dst_port,
  CASE WHEN code = 3 THEN 'host' || (u % 50) || '.example' END AS dst_domain,
  CASE WHEN code = 7 THEN {base("loaded")} END AS file_name,
  CASE WHEN code IN (12, 13) THEN lower(key) END AS registry_path,
  CASE WHEN code IN (12, 13) THEN lower(details) END AS registry_value,
  CASE WHEN code = 22 THEN 'site' || (u % 70) || '.example' END AS dns_name,
  CASE WHEN code = 22 THEN '10.0.0.' || (u % 5) || ',10.0.1.' || (u % 5) END AS dns_answers,
  CASE WHEN code = 22 THEN CAST(u % 3 AS VARCHAR) END AS dns_code,
  CASE WHEN code = 7 THEN 'signature_status=valid' WHEN code = 10 THEN 'granted_access=0x1f' || (u % 9)
    ELSE '' END AS extra
FROM r"""


@query(_SYSMON_SQL)
def normalized_sysmon_other(spark, sf):
    """Connections, terminations, images, threads, access, registry, pipes, names."""
    e = normalize_log(sysmon_other_raw(spark, sf), "sysmon")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("event.severity").alias("severity"),
        c("user.name").alias("user_name"),
        c("user.domain").alias("user_domain"),
        c("process.pid").alias("pid"),
        c("process.name").alias("process"),
        c("process.entity_id").alias("guid"),
        c("target.process.name").alias("target"),
        c("network.direction").alias("direction"),
        c("source.ip").alias("src_ip"),
        c("destination.port").alias("dst_port"),
        c("destination.domain").alias("dst_domain"),
        c("file.name").alias("file_name"),
        c("registry.path").alias("registry_path"),
        c("registry.value").alias("registry_value"),
        c("dns.question.name").alias("dns_name"),
        F.array_join(F.transform("dns.answers", lambda a: a["data"]), ",").alias("dns_answers"),
        c("dns.response_code").alias("dns_code"),
        F.coalesce(extra_text(), lit("")).alias("extra"),
    )


# ------------------------------------------------------------------ Security: audited processes and tasks
TASK_XML = [
    "<Task xmlns=\"http://schemas.example/task\"><Actions><Exec><Command>C:\\Users\\Bob\\Run.exe</Command>"
    "<Arguments>-A  b</Arguments></Exec></Actions></Task>",
    "<Task><Actions><ComHandler><ClassId>{AB-1}</ClassId></ComHandler></Actions></Task>",
    "<Task><Actions><Exec><Command>%windir%\\system32\\ok.exe</Command></Exec></Actions></Task>",
    "not xml",
]
AUDITED = ['cmd.exe /c "whoami /all"', 'tool.exe "two words" Three', "Broken \"quote here", " "]


def security_audit_raw(spark: SparkSession, sf: str) -> DataFrame:
    key, user = c("o_orderkey"), c("o_custkey")
    xml = ad.pick(user % 4, TASK_XML)
    # Zero-padded and 16-digit numbers, as real records have them.
    padded = F.concat(lit("0x"), F.lpad(F.lower(F.hex(key)), 16, "0"))
    return ad.table(spark, sf, "orders").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        ad.iso(c("o_orderdate")).alias("time_created"),
        F.when(key % 3 == 0, 4688).when(key % 3 == 1, 4698).otherwise(4702).alias("event_id"),
        lit("audit").alias("message"),
        ad.data_map(
            SubjectUserName=F.concat(lit("Admin"), user % 30),
            SubjectDomainName=lit("CORP\\"),
            SubjectUserSid=F.concat(lit("S-1-5-21-"), user),
            NewProcessId=F.when(user % 7 == 0, lit("0xFFFFFFFFFFFFFFFF")).when(user % 7 == 1, lit("0xZZ")).otherwise(padded),
            NewProcessName=ad.pick(key % 7, ad.IMAGES),
            CommandLine=ad.pick(user % 4, AUDITED),
            ProcessId=F.concat(lit("0x000000"), F.hex(user)),
            ParentProcessName=ad.pick(user % 5, ad.PARENTS),
            TaskName=F.concat(lit("\\Job"), user % 12),
            TaskContent=xml,
            TaskContentNew=xml,
            ClientProcessId=user,
            FQDN=lit("Host.Example"),
        ).alias("event_data"),
    )


@query(f"""
WITH r AS (SELECT o_orderkey AS ord, o_custkey AS u, o_orderkey % 3 AS kind FROM orders)
SELECT ord,
  CASE kind WHEN 0 THEN 'process_created' WHEN 1 THEN 'scheduled_task_created' ELSE 'scheduled_task_updated' END AS action,
  'admin' || (u % 30) AS user_name, 'corp' AS user_domain, 's-1-5-21-' || u AS user_id,
  CASE WHEN kind <> 0 THEN u WHEN u % 7 IN (0, 1) THEN NULL ELSE ord END AS pid,
  CASE WHEN kind = 0 THEN u END AS parent_pid,
  CASE WHEN kind = 0 THEN {base(pick("ord % 7", ad.IMAGES))}
    WHEN kind = 1 THEN (['run.exe', NULL, 'ok.exe', NULL])[CAST(u % 4 AS INT) + 1]
    ELSE (['run.exe', '{{ab-1}}', 'ok.exe', NULL])[CAST(u % 4 AS INT) + 1] END AS executable,
  CASE WHEN kind = 0 THEN (['whoami|/all', 'tool.exe|two words|three', 'broken|"quote|here', NULL])[CAST(u % 4 AS INT) + 1]
    ELSE (['-a|b', NULL, NULL, NULL])[CAST(u % 4 AS INT) + 1] END AS args,
  CASE WHEN kind = 0 THEN (['whoami /all', 'tool.exe "two words" three', 'broken "quote here', NULL])[CAST(u % 4 AS INT) + 1]
    WHEN kind = 1 THEN (['c:\\users\\bob\\run.exe -a b', NULL, '%windir%\\system32\\ok.exe', NULL])[CAST(u % 4 AS INT) + 1]
    ELSE '\\job' || (u % 12) END AS command
FROM r""")
def normalized_process_audit(spark, sf):
    """Audited processes with padded numbers, created and updated tasks."""
    e = normalize_log(security_audit_raw(spark, sf), "security")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("user.name").alias("user_name"),
        c("user.domain").alias("user_domain"),
        c("user.id").alias("user_id"),
        c("process.pid").alias("pid"),
        c("process.parent.pid").alias("parent_pid"),
        c("process.executable").alias("executable"),
        F.array_join("process.args", "|").alias("args"),
        c("process.command_line").alias("command"),
    )


@query("""
WITH r AS (SELECT o_orderkey AS ord, o_custkey AS u FROM orders WHERE o_orderkey % 3 = 1)
SELECT ord AS event_ord, 'WIN_SCHTASK_CREATED_001' AS rule_id,
  CASE WHEN u % 4 = 1 THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN u % 4 = 1 THEN 0.93 ELSE 0.80 END::DOUBLE AS confidence,
  'job' || (u % 12) AS task_name
FROM r WHERE u % 4 IN (0, 1, 2, 3)""")
def created_task_rule(spark, sf):
    """WIN_SCHTASK_CREATED_001."""
    events = normalize_log(security_audit_raw(spark, sf), "security")
    found = detect(events, RuleSet.of("WIN_SCHTASK_CREATED_001")).whole().findings
    return found.select(
        c("ord.a").alias("event_ord"), "rule_id", "severity", "confidence", c("extra")["task_name"].alias("task_name")
    )


# ------------------------------------------------------------------ System and Application
SYSTEM_CODES = ["7045", "104", "4720", "20", "10016"]


def system_raw(spark: SparkSession, sf: str) -> DataFrame:
    key, user = c("o_orderkey"), c("o_custkey")
    return ad.table(spark, sf, "orders").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        ad.iso(c("o_orderdate")).alias("time_created"),
        ad.pick(key % 5, SYSTEM_CODES).cast("int").alias("event_id"),
        lit("system").alias("message"),
        ad.data_map(
            AccountName=F.concat(lit("CORP\\Svc"), user % 20),
            ServiceName=F.concat(lit("Service"), user % 9),
            ImagePath=ad.pick(user % 7, ad.IMAGES),
            ServiceType=F.when(user % 2 == 0, lit("Kernel Mode Driver")).otherwise(lit("user mode")),
            StartType=lit("Auto"),
            SubjectUserName=F.concat(lit("Admin"), user % 30),
            SubjectDomainName=lit("CORP"),
            Channel=ad.pick(user % 2, ["Security", "System"]),
            BackupPath=lit(""),
            TargetUserName=F.concat(lit("New"), user % 60),
            TargetDomainName=lit("LAB"),
            PrivilegeList=lit("-"),
            updateTitle=F.concat(lit("KB"), user),
            errorCode=lit("0x80070643"),
            param7=F.concat(lit("User"), user % 8),
            param6=lit("NT AUTHORITY"),
            param8=lit("S-1-5-19"),
            param4=lit("{CLSID}"),
            param3=lit("Local"),
        ).alias("event_data"),
    )


@query(f"""
WITH r AS (SELECT o_orderkey AS ord, o_custkey AS u, CAST({pick("o_orderkey % 5", SYSTEM_CODES)} AS INT) AS code FROM orders)
SELECT ord,
  CASE code WHEN 7045 THEN 'service_installed' WHEN 104 THEN 'log_cleared' WHEN 4720 THEN 'user_account_created'
    WHEN 20 THEN 'installation_failed' ELSE 'dcom_permission_error' END AS action,
  CASE code WHEN 7045 THEN CASE WHEN u % 2 = 0 THEN 4 ELSE 3 END WHEN 104 THEN 5 WHEN 4720 THEN 3 WHEN 20 THEN 3 END AS severity,
  CASE code WHEN 7045 THEN 'svc' || (u % 20) WHEN 104 THEN 'admin' || (u % 30) WHEN 4720 THEN 'new' || (u % 60)
    WHEN 10016 THEN 'user' || (u % 8) END AS user_name,
  CASE code WHEN 7045 THEN 'corp' WHEN 104 THEN 'corp' WHEN 4720 THEN 'lab' WHEN 10016 THEN 'nt authority' END AS user_domain,
  CASE code
    WHEN 7045 THEN {_sql_map({"service_file_path": "lower(" + pick("u % 7", ad.IMAGES) + ")", "service_name": "'service' || (u % 9)",
                              "service_type": "CASE WHEN u % 2 = 0 THEN 'kernel mode driver' ELSE 'user mode' END", "start_type": "'auto'"})}
    WHEN 104 THEN {_sql_map({"channel_cleared": "lower(" + pick("u % 2", ["Security", "System"]) + ")"})}
    WHEN 4720 THEN {_sql_map({"created_by": "'admin' || (u % 30)", "privileges": "'-'"})}
    WHEN 20 THEN {_sql_map({"error_code": "'0x80070643'", "update_title": "'kb' || u"})}
    ELSE {_sql_map({"clsid": "'{clsid}'", "component": "'{clsid}'", "permission_type": "'local'"})} END AS extra
FROM r""")
def normalized_system(spark, sf):
    """Services, cleared logs, accounts, failed updates, component errors."""
    e = normalize_log(system_raw(spark, sf), "system")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("event.severity").alias("severity"),
        c("user.name").alias("user_name"),
        c("user.domain").alias("user_domain"),
        extra_text(),
    )


_CLEARED = next(r for r in fv.RULE_CATALOG if r[0] == "WIN_LOG_CLEARED_001")


@query(f"""
SELECT o_orderkey AS event_ord, {q(_CLEARED[3])} AS severity,
  'Windows logs cleared by ''admin' || (o_custkey % 30) || '''' AS description,
  lower({pick("o_custkey % 2", ["Security", "System"])}) AS channel_cleared
FROM orders WHERE o_orderkey % 5 = 1""")
def cleared_log_rule(spark, sf):
    """WIN_LOG_CLEARED_001."""
    found = detect(normalize_log(system_raw(spark, sf), "system"), RuleSet.of("WIN_LOG_CLEARED_001")).whole().findings
    return found.select(
        c("ord.a").alias("event_ord"), "severity", "description", c("extra")["channel_cleared"].alias("channel_cleared")
    )


def application_raw(spark: SparkSession, sf: str) -> DataFrame:
    key = c("c_custkey")
    return ad.table(spark, sf, "customer").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        lit("2024-01-01T00:00:00Z").alias("time_created"),
        ad.pick(key % 4, ["23", "24", "8198", "77"]).cast("int").alias("event_id"),
        lit("application").alias("message"),
        ad.data_map(
            Operation=F.concat(lit("Op"), key % 6),
            PackageFamily=lit("Pkg"),
            OperationError=F.when(key % 3 == 0, lit("0x1")),
            RepairTriggerError=lit(" "),
            Hr=F.when(key % 5 == 0, lit("0X80070005")).otherwise(lit("")),
            ErrorCode=lit("0xC0"),
        ).alias("event_data"),
    )


@query("""
WITH r AS (SELECT c_custkey AS ord FROM customer WHERE c_custkey % 4 <> 3)
SELECT ord,
  CASE ord % 4 WHEN 0 THEN 'app_repair_triggered' WHEN 1 THEN 'app_repair_finished'
    ELSE 'software_protection_service_error' END AS action,
  CASE WHEN ord % 4 <> 2 THEN 'op' || (ord % 6) END AS operation,
  CASE WHEN ord % 4 <> 2 AND ord % 3 = 0 THEN '0x1' END AS operation_error,
  CASE WHEN ord % 4 = 2 THEN CASE WHEN ord % 5 = 0 THEN '0x80070005' ELSE '0xc0' END END AS error_code
FROM r""")
def normalized_application(spark, sf):
    """Application repair and software protection records; other ids are left out."""
    e = normalize_log(application_raw(spark, sf), "application")
    extra = c("winlog.extra")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        extra["operation"].alias("operation"),
        extra["operation_error"].alias("operation_error"),
        extra["error_code"].alias("error_code"),
    )


# ------------------------------------------------------------------ WMI beyond subscriptions
def wmi_other_raw(spark: SparkSession, sf: str) -> DataFrame:
    key = c("c_custkey")
    started = F.concat(
        lit("CIMWin32 provider started with result code 0x0. HostProcess = wmiprvse.exe; ProcessID = "), key,
        lit("; ProviderPath = %systemroot%\\system32\\wbem\\Cim.dll"),
    )
    failed = F.concat(
        lit("Id = {1}; ClientMachine = PC"), key % 9, lit("; User = CORP\\Op"), key % 5, lit("; ClientProcessId = "), key,
        lit("; Operation = x = y"),
    )
    notified = F.concat(lit("Namespace = //./root; Provider = Prov"), key % 4, lit(", queryID = 1; HostProcessID = "), key, lit("; OwnerName = S-1-5-18"))
    asked = F.concat(lit("Namespace = root; UserName = NT\\Sys; ClientProcessID = "), key, lit(", ClientMachine = HOST"), key % 3, lit("; PossibleCause = Temporary"))
    return ad.spread(ad.table(spark, sf, "customer"), "c_custkey").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        lit("2024-01-01T00:00:00Z").alias("time_created"),
        (lit(5857) + key % 4).cast("int").alias("event_id"),
        F.get(F.array(started, failed, notified, asked), (key % 4).cast("int")).alias("message"),
    )


@query("""
SELECT c_custkey AS ord,
  (['wmi_provider_start', 'wmi_query_error', 'wmi_notification_query', 'wmi_subscription_query'])[CAST(c_custkey % 4 AS INT) + 1] AS action,
  (['cimwin32', 'Microsoft-Windows-WMI-Activity', 'prov' || (c_custkey % 4), 'WMI Subscription'])[CAST(c_custkey % 4 AS INT) + 1] AS provider,
  c_custkey AS pid,
  CASE c_custkey % 4 WHEN 0 THEN 'wmiprvse.exe' END AS process,
  CASE c_custkey % 4 WHEN 1 THEN 'op' || (c_custkey % 5) WHEN 3 THEN 'sys' END AS user_name,
  CASE c_custkey % 4 WHEN 2 THEN 's-1-5-18' END AS user_id,
  CASE c_custkey % 4 WHEN 1 THEN 'pc' || (c_custkey % 9) WHEN 3 THEN 'host' || (c_custkey % 3) END AS hostname,
  CASE c_custkey % 4 WHEN 0 THEN '0x0' END AS result_code
FROM customer""")
def normalized_wmi_other(spark, sf):
    """Provider starts, query errors, notification and temporary queries."""
    e = normalize_log(wmi_other_raw(spark, sf), "wmi")
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("event.provider").alias("provider"),
        c("process.pid").alias("pid"),
        c("process.name").alias("process"),
        c("user.name").alias("user_name"),
        c("user.id").alias("user_id"),
        c("host.hostname").alias("hostname"),
        c("winlog.extra")["result_code"].alias("result_code"),
    )


# ------------------------------------------------------------------ snapshots and error lines
@query(f"""
SELECT s_suppkey AS ord, 'svc' || (s_suppkey % 6) AS user_name, nullif(s_suppkey % 50, 0) AS pid,
  {base(pick("s_suppkey % 7", ad.IMAGES))} AS process,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'ab' || s_suppkey END AS hash,
  CASE WHEN s_suppkey % 3 = 0 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') END AS start_us
FROM supplier""")
def process_snapshots(spark, sf):
    """Processes of a snapshot; 0 is no process, ``no_path`` no hash."""
    key = c("s_suppkey")
    rows = ad.table(spark, sf, "supplier").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        F.concat(lit("LAB\\Svc"), key % 6).alias("owner"),
        (key % 50).cast("string").alias("pid"),
        F.concat(lit('"'), ad.pick(key % 7, ad.IMAGES), lit('"')).alias("name"),
        lit("x").alias("command_line"),
        lit(None).cast("string").alias("executable_path"),
        F.when(key % 4 == 0, lit("no_path")).otherwise(F.concat(lit("AB"), key)).alias("hash_sha256"),
        F.when(key % 3 == 0, lit("2024-01-02T03:04:05Z")).otherwise(lit("soon")).alias("start_time"),
        lit("4").alias("parent_pid"),
    )
    e = normalize_processes(rows)
    return e.select(
        "ord",
        c("user.name").alias("user_name"),
        c("process.pid").alias("pid"),
        c("process.name").alias("process"),
        c("process.hash_sha256").alias("hash"),
        F.unix_micros("process.start").alias("start_us"),
    )


NETWORK_KINDS = ["interfaces", "tcp_connections", "udp_endpoints", "listening_ports", "arp_cache", "dns_cache"]


@query("""
SELECT c_custkey AS ord,
  (['network_interface_snapshot', 'tcp_None', 'udp_endpoint', 'listening_port', 'arp_cache_entry', 'dns_cache_entry'])[CAST(c_custkey % 6 AS INT) + 1]
    AS action,
  CASE WHEN c_custkey % 6 IN (1, 2, 3) THEN '10.0.0.' || (c_custkey % 9) END AS src_ip,
  CASE WHEN c_custkey % 6 IN (1, 2, 3) AND c_custkey % 5 <> 0 THEN c_custkey % 100 END AS src_port,
  CASE WHEN c_custkey % 6 IN (0, 4) THEN '192.168.1.' || (c_custkey % 7) END AS host_ip,
  CASE WHEN c_custkey % 6 = 4 THEN 'aa:bb' END AS mac,
  CASE WHEN c_custkey % 6 IN (0, 4) THEN 'eth0' END AS interface,
  CASE c_custkey % 6 WHEN 1 THEN '8.8.8.8' WHEN 5 THEN '10.9.9.' || (c_custkey % 4) END AS dst_ip,
  CASE WHEN c_custkey % 6 = 5 THEN 'name' || (c_custkey % 8) || '.example' END AS url
FROM customer""")
def network_snapshots(spark, sf):
    """All six kinds of network rows."""
    key = c("c_custkey")
    rows = ad.table(spark, sf, "customer").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        ad.pick(key % 6, NETWORK_KINDS).alias("kind"),
        F.concat(lit("10.0.0."), key % 9).alias("local_address"),
        F.when(key % 5 == 0, lit("any")).otherwise((key % 100).cast("string")).alias("local_port"),
        lit("8.8.8.8").alias("remote_address"),
        lit("53").alias("remote_port"),
        lit("").alias("state"),
        lit("0").alias("pid"),
        lit("").alias("process_name"),
        F.concat(lit("192.168.1."), key % 7).alias("ip_address"),
        lit("AA:BB").alias("mac_address"),
        lit("Eth0").alias("interface"),
        lit("").alias("gateway"),
        lit(None).cast("string").alias("dns_servers"),
        F.concat(lit("10.9.9."), key % 4).alias("data"),
        F.concat(lit("Name"), key % 8, lit(".Example")).alias("entry"),
    )
    e = normalize_network(rows)
    return e.select(
        "ord",
        c("event.action").alias("action"),
        c("source.ip").alias("src_ip"),
        c("source.port").alias("src_port"),
        c("host.ip").alias("host_ip"),
        c("host.mac").alias("mac"),
        c("network.name").alias("interface"),
        c("destination.ip").alias("dst_ip"),
        c("url.original").alias("url"),
    )


@query("""
SELECT event_id AS ord, epoch_us(TIMESTAMP '2024-01-03 04:05:06') + (user_id % 1000) * 1000 AS at_us,
  CASE WHEN user_id % 4 <> 0 THEN '10.0.0.' || (user_id % 9) END AS ip,
  CASE WHEN user_id % 4 <> 0 THEN user_id % 60000 END AS port
FROM events""")
def error_log_lines(spark, sf):
    """Error-log entries; the client is an address with a port, or nothing."""
    user = c("user_id")
    rows = ad.table(spark, sf, "events").select(
        lit("web").alias("collection_id"),
        c("event_id").alias("ord"),
        F.concat(lit("Wed Jan  3 04:05:06."), F.lpad((user % 1000).cast("string"), 3, "0"), lit("000 2024")).alias("timestamp"),
        lit("core:error").alias("level"),
        lit("core").alias("module"),
        F.when(user % 4 != 0, F.concat(lit("10.0.0."), user % 9, lit(":"), user % 60000)).alias("client"),
        lit("File does not exist").alias("message"),
    )
    e = normalize_error(rows)
    return e.select(
        "ord", F.unix_micros("timestamp").alias("at_us"), c("source.ip").alias("ip"), c("source.port").alias("port")
    )


# ------------------------------------------------------------------ reports
def order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as graph nodes; every third belongs to no actor."""
    key = c("o_orderkey")
    return ad.table(spark, sf, "orders").select(
        F.concat(lit("h"), c("o_custkey") % 20).alias("collection_id"),
        F.lpad(key.cast("string"), 12, "0").alias("id"),
        F.concat(lit("Rule "), c("o_orderpriority")).alias("label"),
        F.when(key % 3 != 0, (c("o_custkey") % 7).cast("int")).alias("actor"),
        c("o_orderdate").alias("event_time"),
        F.struct(
            lit("delivery").alias("kill_chain"),
            F.get(F.array(*[lit(s) for s in fv.SEVERITIES]), (key % 4).cast("int")).alias("severity"),
            F.concat(lit("User"), c("o_custkey") % 300).alias("user"),
            lit("cmd.exe").alias("process"),
            F.when(key % 5 == 0, F.concat(lit("10.0.0."), key % 6)).alias("source_ip"),
            c("o_orderdate").cast("string").alias("timestamp"),
        ).alias("fields"),
    )


@query(f"""
WITH f AS (SELECT 'h' || (o_custkey % 20) AS h, o_custkey % 7 AS actor, o_orderkey % 4 AS rank, o_orderkey AS k FROM orders),
e AS (SELECT 'h' || (user_id % 25) AS h, count(*) AS n FROM events GROUP BY 1)
SELECT 'h' || n_nationkey AS collection_id, coalesce(any_value(e.n), 0) AS event_count,
  count(f.h) AS finding_count, max(CASE WHEN f.k % 3 <> 0 THEN actor END) + 1 AS actor_count,
  ({arr(fv.SEVERITIES)})[CAST(max(rank) AS INT) + 1] AS max_severity
FROM nation LEFT JOIN f ON f.h = 'h' || n_nationkey LEFT JOIN e ON e.h = 'h' || n_nationkey GROUP BY n_nationkey""")
def collection_listing(spark, sf):
    """Collections with their totals."""
    nodes = order_nodes(spark, sf)
    collections = ad.table(spark, sf, "nation").select(
        F.concat(lit("h"), c("n_nationkey")).alias("collection_id"), c("n_name").alias("hostname"), lit("2024").alias("collected_at")
    )
    events = ad.table(spark, sf, "events").select(F.concat(lit("h"), c("user_id") % 25).alias("collection_id"))
    findings = nodes.select("collection_id", c("fields.severity").alias("severity"))
    out = reports.collection_list(collections, events, findings, nodes.select("collection_id", "actor"))
    return out.select("collection_id", "event_count", "finding_count", c("actor_count").cast("bigint").alias("actor_count"), "max_severity")


@query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders
WHERE contains('user' || (o_custkey % 300), 'user12') OR contains('rule ' || lower(o_orderpriority), 'user12')
  OR (o_orderkey % 11 = 0 AND o_custkey % 40 = 12)""")
def node_search(spark, sf):
    """Nodes by their fields, else by a trigger event that holds the text."""
    nodes = order_nodes(spark, sf)
    name = F.when(c("o_orderkey") % 11 == 0, lit("User")).otherwise(lit("Guest"))
    events = ad.table(spark, sf, "orders").select(
        F.concat(lit("h"), c("o_custkey") % 20).alias("collection_id"),
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("finding_id"),
        F.struct(F.concat(name, c("o_custkey") % 40).alias("name")).alias("user"),
    )
    # Trigger users run to 39, so of them only user12 holds the text.
    return reports.search_nodes(nodes, events, " USER12 ").select("id")


@query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders
WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 6 = 3)""")
def isolated_nodes(spark, sf):
    """Findings without an actor, the collector's own address left out."""
    return reports.isolated_findings(order_nodes(spark, sf), ("10.0.0.3",)).select("id")


@query("""
WITH s AS (SELECT o_custkey AS id, o_orderpriority AS signal, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(id AS VARCHAR) AS id, signal, n FROM s WHERE id IN (SELECT id FROM s GROUP BY 1 HAVING sum(n) > 1)""")
def signal_counts(spark, sf):
    """Rules of each fused finding, single signals left out."""
    counts = ad.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(lit(1)).alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n")))
    fused = counts.groupBy(c("o_custkey").cast("string").alias("id")).agg(entries.alias("fused_signals"))
    return reports.fused_signal_counts(fused)


@query("""
WITH a AS (SELECT 'h' || (o_custkey % 20) AS h, count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 7 END) AS n FROM orders GROUP BY 1)
SELECT 'h' || n_nationkey AS collection_id, coalesce(a.n, 0) AS actor_count, n_nationkey % 2 = 0 AS probe,
  CASE WHEN n_nationkey % 2 = 0 THEN '10.0.0.' || n_nationkey || ',10.0.1.' || n_nationkey ELSE '' END AS collector_ips
FROM nation LEFT JOIN a ON a.h = 'h' || n_nationkey""")
def correlation_totals(spark, sf):
    """Actors per collection, whether a collector ran, and its addresses."""
    ips = F.create_map(
        lit("eth0"), F.array(F.concat(lit("10.0.0."), c("n_nationkey"))), lit("eth1"), F.array(F.concat(lit("10.0.1."), c("n_nationkey")))
    )
    collections = ad.table(spark, sf, "nation").select(
        F.concat(lit("h"), c("n_nationkey")).alias("collection_id"), F.when(c("n_nationkey") % 2 == 0, ips).alias("collector_ip")
    )
    out = reports.correlation_summary(collections, order_nodes(spark, sf).select("collection_id", "actor"))
    return out.withColumn("collector_ips", F.array_join("collector_ips", ","))
