"""Schemas of the raw collection, the normalised event, and the result relations."""

from __future__ import annotations



_PROCESS = (
    "args ARRAY<STRING>, args_count INT, command_line STRING, `end` TIMESTAMP, entity_id STRING, "
    "executable STRING, hash_sha256 STRING, exit_code BIGINT, interactive BOOLEAN, name STRING, "
    "pid BIGINT, start TIMESTAMP"
)

# One entry per top-level member of the event, in column order.
EVENT_STRUCTS = {
    "event": "action STRING, category STRING, code STRING, created TIMESTAMP, dataset STRING, "
    "module STRING, original BINARY, provider STRING, risk_score DOUBLE, severity INT, "
    "severity_label STRING, reason STRING",
    "host": "architecture STRING, domain STRING, hostname STRING, ip STRING, name STRING, "
    "os STRUCT<family: STRING, full: STRING>, mac STRING",
    "user": "name STRING, domain STRING, id STRING",
    "process": f"{_PROCESS}, parent STRUCT<{_PROCESS}>",
    "target": "process STRUCT<pid: BIGINT, executable: STRING, name: STRING>",
    "network": "protocol STRING, transport STRING, direction STRING, name STRING, "
    "gateway STRING, dns_servers STRING",
    "source": "address STRING, ip STRING, port INT, mac STRING",
    "destination": "address STRING, ip STRING, port INT, domain STRING",
    "registry": "path STRING, value STRING, data STRING",
    "winlog": "channel STRING, event_id INT, provider_name STRING, computer_name STRING, "
    "extra MAP<STRING, STRING>",
    "logon": "id STRING, type STRING",
    "http": "request_method STRING, response_status_code INT, user_agent STRING, "
    "request_body STRING",
    "url": "original STRING, path STRING",
    "file": "path STRING, name STRING, created TIMESTAMP",
    "dns": "question STRUCT<name: STRING, type: STRING>, "
    "answers ARRAY<STRUCT<data: STRING, type: STRING>>, response_code STRING",
    "group": "name STRING, domain STRING, id STRING, member_id STRING, member_name STRING",
    "powershell": "script_block_id STRING, script_block_text STRING, runspace_id STRING, "
    "sequence_number INT",
}

EVENT_KEYS = "collection_id STRING, channel STRING, ord BIGINT, id STRING"


def _ddl_struct(ddl: str) -> str:
    return f"STRUCT<{ddl}>"


EVENT_DDL = ", ".join(
    [EVENT_KEYS, "timestamp TIMESTAMP"]
    + [f"`{name}` {_ddl_struct(ddl)}" for name, ddl in EVENT_STRUCTS.items()]
    + ["is_probe BOOLEAN"]
)

CAPABILITY = "STRUCT<name: STRING, bind: ARRAY<STRING>, values: ARRAY<STRING>>"

# Facts of the first trigger of a finding; correlation needs nothing else from the events.
FACTS = (
    "STRUCT<event_time: TIMESTAMP, ip: STRING, guid: STRING, pid: BIGINT, parent_guid: STRING, "
    "parent_pid: BIGINT, process: STRING, user: STRING>"
)

# ``ord`` puts findings in the order the rules were applied.
FINDING_ORD = "STRUCT<channel: STRING, phase: INT, a: BIGINT, b: BIGINT>"

FINDING_DDL = (
    f"collection_id STRING, channel STRING, id STRING, ord {FINDING_ORD}, timestamp TIMESTAMP, "
    "rule_id STRING, rule_name STRING, rule_type STRING, "
    f"requires ARRAY<{CAPABILITY}>, provides ARRAY<{CAPABILITY}>, "
    "fusion_key ARRAY<ARRAY<STRING>>, severity STRING, confidence DOUBLE, technique_id STRING, "
    "technique_name STRING, tactic STRING, kill_chain_phase STRING, tags ARRAY<STRING>, "
    "source STRING, description STRING, event_count BIGINT, extra MAP<STRING, STRING>, "
    f"entities MAP<STRING, STRING>, logon_id STRING, is_probe BOOLEAN, facts {FACTS}"
)

# One row per (finding, triggering event): the list a finding would otherwise have to carry.
TRIGGER_DDL = "collection_id STRING, channel STRING, finding_id STRING, event_id STRING, ord BIGINT, value STRING"

_WIN_EVENT = (
    "STRUCT<time_created: STRING, event_id: INT, message: STRING, level: INT, "
    "event_data: MAP<STRING, STRING>, computer: STRING, Computer_: STRING, hostname: STRING, "
    "host: STRING>"
)

LOG_CHANNELS = ("wmi", "security", "sysmon", "application", "system", "powershell")

# Module bodies whose members may be an object, an array or null stay text until they are
# fanned out; see ``sources.collection``.
COLLECTION_DDL = (
    "metadata STRUCT<hostname: STRING, collected_at: STRING, os_version: STRING>, "
    "modules STRUCT<event_logs: STRING, processes: STRING, network: STRING, registry: STRING, "
    "scheduled_tasks: STRING, web_logs: STRING>, "
    "module_hashes MAP<STRING, STRING>"
)

WIN_EVENT_DDL = _WIN_EVENT.replace(", Computer_: STRING", "")

NETWORK_ROW_DDL = (
    "STRUCT<interface: STRING, ip_address: STRING, gateway: STRING, dns_servers: STRING, "
    "local_address: STRING, local_port: STRING, remote_address: STRING, remote_port: STRING, "
    "state: STRING, pid: STRING, process_name: STRING, mac_address: STRING, entry: STRING, "
    "record_name: STRING, data: STRING, ttl: STRING>"
)
REGISTRY_ROW_DDL = (
    "STRUCT<name: STRING, value: STRING, imagepath: STRING, start: STRING, type: STRING>"
)
PROCESS_ROW_DDL = (
    "STRUCT<name: STRING, pid: STRING, parent_pid: STRING, executable_path: STRING, "
    "command_line: STRING, owner: STRING, hash_sha256: STRING, start_time: STRING>"
)
TASK_ROW_DDL = (
    "STRUCT<task_path: STRING, task_name: STRING, state: STRING, actions: STRING, "
    "last_run: STRING, next_run: STRING, last_result: STRING>"
)
WEB_ENTRY_DDL = (
    "STRUCT<client_ip: STRING, timestamp: STRING, method: STRING, path: STRING, "
    "status_code: INT, bytes: BIGINT, referer: STRING, user_agent: STRING, level: STRING, "
    "module: STRING, client: STRING, message: STRING>"
)
