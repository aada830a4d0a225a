"""Row rules: each is a predicate and a set of result columns over ``rule_view`` columns.

All of them run in one pass over the events; see ``plans.detect``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.schemas import CAPABILITY

c = F.col

CAP_LIST = f"array<{CAPABILITY}>"
KEY_LIST = "array<array<string>>"


def capability(name: str, **bound: Column) -> Column:
    """A contract: its name, the bound fields and their values."""
    return F.struct(
        F.lit(name).alias("name"),
        F.array(*[F.lit(b) for b in bound]).alias("bind"),
        F.array(*[v.cast("string") for v in bound.values()]).alias("values"),
    )


def session_capability(logon: Column) -> Column:
    """Session contracts bind one field name everywhere, whichever rule states them."""
    return F.struct(
        F.lit("session_established").alias("name"),
        F.array(F.lit("logon.id")).alias("bind"),
        F.array(logon).alias("values"),
    )


@dataclass(frozen=True)
class RowRule:
    """``when`` selects events; the other columns describe the finding."""

    rule_id: str
    when: Column
    description: Column
    extra: dict[str, Column] = field(default_factory=dict)
    entities: dict[str, Column] = field(default_factory=dict)
    requires: tuple[tuple[Column | None, Column], ...] = ()
    provides: tuple[tuple[Column | None, Column], ...] = ()
    keys: tuple[tuple[Column, ...], ...] = ()
    severity: Column | None = None
    confidence: Column | None = None
    technique: tuple[Column, Column] | None = None
    event_count: int = 1


def text(template: str, *parts: Column) -> Column:
    """``format_string`` with nulls shown as None."""
    return F.format_string(template, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _web_extra() -> dict[str, Column]:
    return {"source_ip": c("src_ip"), "url": c("url"), "status_code": c("status")}


def _web_entities() -> dict[str, Column]:
    return {"source_ip": c("src_ip"), "file_name": x.url_file_name(c("url"))}


def account_rules() -> list[RowRule]:
    # "Generic" ids are compared without regard to case: normalised ids are lower case.
    generic_sid = F.coalesce(F.upper(c("user_id")).isin(*fv.GENERIC_SIDS), F.lit(False))
    logon_type = x.strip(c("logon_type")).try_cast("int")
    named = c("user_name") != ""
    return [
        RowRule(
            "WIN_USER_CREATED_001",
            c("action") == "user_account_created",
            text("New account created: '%s'", c("user_name")),
            extra={
                "created_user": c("user_name"),
                "domain": c("user_domain"),
                "user_sid": c("user_id"),
            },
            requires=((named, capability("local_account_created", username=c("user_name"))),),
            provides=((None, capability("account_created", user_sid=c("user_id"))),),
        ),
        RowRule(
            "WIN_GROUP_ADD_001",
            c("has_group") & c("group_name").isin(*fv.PRIVILEGED_GROUPS),
            text("User added to privileged group '%s'", c("group_name")),
            extra={"group_name": c("group_name"), "member_sid": c("member_sid")},
            requires=(
                (c("member_sid").isNotNull(), capability("account_created", user_sid=c("member_sid"))),
            ),
            provides=(
                (
                    c("member_sid").isNotNull(),
                    capability("account_privileged", user_sid=c("member_sid")),
                ),
            ),
        ),
        RowRule(
            "WIN_REMOTE_LOGIN_001",
            c("has_user") & logon_type.isin(*fv.REMOTE_LOGON_TYPES) & ~generic_sid,
            text("Remote logon by '%s' — possible attacker-created account", c("user_name")),
            extra={
                "logon_user": c("user_name"),
                "user_sid": c("user_id"),
                "source_ip": c("src_ip"),
                "logon_type": logon_type,
            },
            requires=(
                (
                    x.non_empty(c("user_id")).isNotNull(),
                    capability("account_privileged", user_sid=c("user_id")),
                ),
            ),
            provides=((c("own_logon_id").isNotNull(), session_capability(c("own_logon_id"))),),
        ),
    ]


def network_rules() -> list[RowRule]:
    listener = x.matches(c("process"), fv.LISTENER_PROCESS)
    state = F.lower(c("action"))
    bound_only = state.contains("bound") & ~state.contains("listen")
    common = {"process": c("process"), "pid": c("pid")}
    remote = {**common, "dst_ip": c("dst_ip"), "dst_port": c("dst_port")}

    def local_only(ip: Column, *prefixes: str) -> Column:
        return ip.isNull() | x.any_of([ip.startswith(p) for p in prefixes])

    return [
        RowRule(
            "NET_SUSPICIOUS_LISTENER_001",
            c("has_network")
            & c("has_process")
            & (c("src_port").isNull() | (c("src_port") <= fv.EPHEMERAL_PORT_START))
            & ~bound_only
            & listener,
            text("'%s' listening on port %s — possible backdoor", c("process"), c("src_port")),
            extra={**common, "listening_port": c("src_port")},
        ),
        RowRule(
            "NET_SUSPICIOUS_PORT_001",
            c("has_network") & c("src_port").isin(*fv.SUSPICIOUS_PORTS),
            text("Suspicious port %s open — process: '%s'", c("src_port"), c("process")),
            extra={"port": c("src_port"), **common},
        ),
        RowRule(
            "NET_REVERSE_SHELL_001",
            c("has_network")
            & c("has_destination")
            & c("dst_port").isin(*fv.SUSPICIOUS_PORTS)
            & listener,
            text("Possible reverse shell: '%s' → %s:%s", c("process"), c("dst_ip"), c("dst_port")),
            extra=remote,
        ),
        RowRule(
            "NET_SUSPICIOUS_OUTBOUND_001",
            c("has_network")
            & c("has_destination")
            & c("dst_port").isin(*fv.SUSPICIOUS_PORTS)
            & ~bound_only
            & listener,
            text("'%s' outbound → %s:%s", c("process"), c("dst_ip"), c("dst_port")),
            extra=remote,
        ),
        RowRule(
            "NET_SUSPICIOUS_SSH_001",
            c("has_network")
            & F.lower(c("process")).isin("sshd", "sshd.exe")
            & ~local_only(c("src_ip"), "127.", "::", "0.0.0.0")
            & ~local_only(c("dst_ip"), "127.", "::", "0.0.0.0"),
            text("SSH connection from %s", c("dst_ip")),
            extra={"remote_ip": c("dst_ip"), "process": F.lit("sshd")},
        ),
        RowRule(
            "NET_WEBSERVER_INBOUND_001",
            c("has_network")
            & c("has_process")
            & ~state.contains("listen")
            & ~state.contains("bound")
            & ~local_only(c("src_ip"), "127.", "::1", "0.0.0.0", "0:0:0")
            & x.matches(c("process"), fv.INBOUND_WEB_SERVER),
            text("Inbound connection to '%s' from %s", c("process"), c("src_ip")),
            extra={**common, "src_ip": c("src_ip")},
            keys=((F.lit("INBOUND_CON_WITH_LOGON"), F.lit("IP_ADDRESS"), c("src_ip")),),
        ),
    ]


def process_rules() -> list[RowRule]:
    command = c("command")
    has_command = c("has_process") & command.isNotNull()
    watched = x.matches(c("process"), fv.WATCHED_PROCESS)
    suspicious = x.matches(command, fv.SUSPICIOUS_COMMAND)
    web_parent = (c("parent") != "") & x.matches(c("parent"), fv.WEB_SERVER_PARENT)
    needs_code = ((None, capability("code_execution", command_line=command)),)
    run_key = (F.lit("command_execution"), command)
    details = {
        "process": c("process"),
        "pid": c("pid"),
        "command_line": command,
        "username": c("user_name"),
    }
    direct = ~c("process").isin("cmd.exe", "powershell.exe")
    new_task = F.when(direct, F.trim(x.group(command, fv.SCHTASKS_CREATE, flags="isU"), F.lit("'\"")))
    new_run_value = F.when(direct, F.trim(x.group(command, fv.REG_RUN_ADD, flags="isU"), F.lit("'\"")))
    created_user = F.lower(
        F.trim(x.group(command, fv.NET_USER_ADD, flags="isU"), F.lit("'\""))
    )
    kinds = F.concat_ws(
        ", ",
        F.when(new_task.isNotNull(), F.lit("task_name")),
        F.when(new_run_value.isNotNull(), F.lit("runkey_value")),
    )
    return [
        RowRule(
            "PROC_SUSPICIOUS_001",
            has_command & watched & suspicious,
            text("'%s' executed with suspicious command line", c("process")),
            extra=details,
            requires=needs_code,
            keys=(run_key,),
        ),
        RowRule(
            "PROC_WEBSHELL_CHILD_001",
            c("has_process")
            & web_parent
            & watched
            & ~x.installer_activity(c("process"), command, c("parent_command")),
            text("'%s' spawned by web server '%s'", c("process"), c("parent")),
            extra={
                "child_process": c("process"),
                "child_pid": c("pid"),
                "parent_process": c("parent"),
                "parent_pid": c("parent_pid"),
                "command_line": command,
            },
            requires=((command.isNotNull(), capability("web_command", command_line=command)),),
            provides=((command.isNotNull(), capability("code_execution", command_line=command)),),
            keys=((F.lit("webshell_process"), command),),
        ),
        RowRule(
            "WIN_SUSPICIOUS_CMDLINE_001",
            has_command & ~web_parent & suspicious,
            text("Suspicious command line: '%s'", F.substring(command, 1, 120)),
            requires=needs_code,
            keys=(run_key,),
        ),
        RowRule(
            "WIN_CMD_USER_CREATION_001",
            has_command & c("process").isin("net.exe", "net1.exe") & created_user.isNotNull(),
            text("Local account '%s' created via command", created_user),
            extra={
                "created_user": created_user,
                "command_line": command,
                "process": c("process"),
                "parent": c("parent"),
            },
            provides=((None, capability("local_account_created", username=created_user)),),
            keys=((F.lit("command_line"), command),),
        ),
        RowRule(
            "WIN_CMD_PERSISTENCE_ARTIFACT_001",
            has_command & (new_task.isNotNull() | new_run_value.isNotNull()),
            text(
                "Persistence artifact via command (%s): '%s'", kinds, F.substring(command, 1, 100)
            ),
            extra={
                "command_line": command,
                "process": c("process"),
                "parent": c("parent"),
                "username": c("user_name"),
                "task_name": new_task,
                "runkey_value": new_run_value,
            },
            provides=(
                (new_task.isNotNull(), capability("task_created", task_name=new_task)),
                (new_run_value.isNotNull(), capability("runkey_created", value_name=new_run_value)),
            ),
            keys=((F.lit("task_name"), new_task), (F.lit("value_name"), new_run_value)),
            technique=(
                F.when(new_task.isNotNull(), F.lit("T1053.005")).otherwise(F.lit("T1547.001")),
                F.when(new_task.isNotNull(), F.lit("Scheduled Task/Job: Scheduled Task")).otherwise(
                    F.lit("Boot or Logon Autostart: Registry Run Keys")
                ),
            ),
        ),
    ]


def registry_rules() -> list[RowRule]:
    path = F.coalesce(F.lower(c("registry_path")), F.lit(""))
    data = F.coalesce(c("registry_data"), F.lit(""))
    value = F.coalesce(c("registry_value"), F.lit(""))
    in_path = x.matches(data, fv.RUN_DATA_PATH)
    in_web = x.matches(data, fv.RUN_DATA_WEB_PATH)
    hidden = x.matches(data, fv.RUN_DATA_COMMAND)
    worst = in_web | (hidden & in_path)
    edited = (None, capability("registry_edited", path=c("registry_path"), value=c("registry_value")))
    return [
        RowRule(
            "REG_RUNKEY_001",
            c("has_registry") & x.matches(path, fv.RUN_KEY) & (in_path | in_web | hidden),
            text("Run key suspect: '%s' → '%s'", value, F.substring(data, 1, 100)),
            extra={
                "registry_path": path,
                "value_name": value,
                "executable": data,
                "in_suspicious_path": in_path,
            },
            requires=((None, capability("runkey_created", value_name=value)), edited),
            keys=((path, value),),
            severity=F.when(worst | hidden, F.lit("critical")).otherwise(F.lit("high")),
            confidence=F.when(worst, F.lit(0.97)).when(hidden, F.lit(0.93)).otherwise(F.lit(0.80)),
        ),
        RowRule(
            "REG_DEFENDER_EXCLUSION_001",
            c("has_registry") & x.matches(path, fv.DEFENDER_EXCLUSION),
            text("Defender exclusion in registry: '%s'", value),
            extra={"registry_path": path, "value_name": value, "excluded_path": data},
            requires=(edited,),
        ),
        RowRule(
            "REG_SUSPICIOUS_SERVICE_001",
            c("has_registry")
            & path.contains(fv.SERVICE_KEY)
            & x.matches(data, fv.SERVICE_EXTENSION)
            & x.matches(data, fv.SERVICE_PATH)
            & ~x.matches(value, fv.LEGITIMATE_SERVICE),
            text("Suspicious service in registry: '%s' → '%s'", value, F.substring(data, 1, 100)),
            extra={"registry_path": path, "service_name": value, "image_path": data},
            requires=(edited,),
        ),
    ]


def evasion_rules() -> list[RowRule]:
    return [
        RowRule(
            "WIN_LOG_CLEARED_001",
            c("event_code") == 104,
            text("Windows logs cleared by '%s'", c("user_name")),
            extra={
                "username": c("user_name"),
                "channel_cleared": c("winlog_extra")["channel_cleared"],
            },
        )
    ]


def file_rules() -> list[RowRule]:
    path = c("file_path")
    lower_path = F.lower(path)
    logon = c("own_logon_id")
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    has_name = name != ""
    sensitive = x.matches(path, fv.SENSITIVE_EXTENSION)
    deletion = {
        "file_path": path,
        "file_name": name,
        "process": c("process"),
    }
    shared = {
        "requires": ((logon.isNotNull(), session_capability(logon)),),
        "provides": ((has_name, capability("file_deleted", file_name=name)),),
        "keys": ((F.lit("file_deletion"), lower_path),),
        "entities": {"file_name": name, "file_path": path},
    }
    return [
        RowRule(
            "SYS_SUSPICIOUS_FILE_DROP_001",
            (c("event_code") == 11)
            & path.isNotNull()
            & x.matches(lower_path, fv.DROP_EXTENSION)
            & x.matches(lower_path, fv.DROP_PATH)
            & ~x.matches(lower_path, fv.DROP_BENIGN_PATH)
            & ~x.matches(c("process"), fv.DROP_BENIGN_PROCESS),
            text("Executable created in suspicious location: '%s'", lower_path),
            extra={"file_path": lower_path, "process": c("process")},
            entities={"host": c("host")},
            requires=((logon.isNotNull(), session_capability(logon)),),
        ),
        RowRule(
            "WIN_SENSITIVE_FILE_DELETE_001",
            (c("event_code") == 26)
            & path.isNotNull()
            & (sensitive | x.matches(path, fv.SENSITIVE_PATH)),
            text("Deletion of sensitive file: %s", path),
            extra={**deletion, "logon_id": logon, "source_ip": c("src_ip")},
            **shared,
        ),
        RowRule(
            "WIN_SYSTEM_FILE_DELETE_001",
            (c("event_code") == 26)
            & path.isNotNull()
            & x.matches(path, fv.SYSTEM_DRIVE_PATH)
            & sensitive,
            text("Deletion of system/critical binary: %s", path),
            extra={**deletion, "parent_process": c("parent"), "logon_id": logon},
            **shared,
        ),
    ]


def task_rules() -> list[RowRule]:
    command = c("command")
    task = c("code")
    is_task = F.coalesce(c("dataset") == fv.TASK_DATASET, F.lit(False))
    runs = is_task & command.isNotNull()
    keys = ((F.lit("scheduled_task"), task), (F.lit("command_execution"), command))
    details = {
        "task_name": task,
        "command": command,
        "executable": c("executable"),
        "state": c("action"),
    }

    lolbin = F.lower(
        F.coalesce(x.group(c("executable"), fv.TASK_LOLBIN), x.group(command, fv.TASK_LOLBIN))
    )
    joined = x.non_empty(F.array_join(c("args"), " "))
    from_args = x.non_empty(
        x.strip(F.substring_index(x.strip(F.regexp_replace(joined, fv.RUNDLL_SWITCH, "")), ",", 1))
    )
    target = F.coalesce(from_args, x.strip(x.group(command, fv.RUNDLL_TARGET)))
    ordinary_dll = (
        x.matches(F.coalesce(joined, command), fv.WINDOWS_DIR)
        | F.coalesce(target.rlike(r"[/\\]"), F.lit(False))
        | x.matches(target, fv.KNOWN_SYSTEM_DLL)
    )

    created_name = F.when(
        F.map_contains_key(c("winlog_extra"), "task_name"), c("winlog_extra")["task_name"]
    ).otherwise(F.lit("-"))
    uses_com = F.coalesce(c("winlog_extra")["uses_com_handler"] == "true", F.lit(False))
    created_exe = F.coalesce(x.non_empty(c("winlog_extra")["executable"]), c("executable"))

    return [
        RowRule(
            "TASK_WEBROOT_EXEC_001",
            runs & x.matches(command, fv.TASK_PATH),
            text("Task '%s' executes from web-accessible path: %s", task, command),
            extra=details,
            requires=((None, capability("task_created", task_name=task)),),
            keys=keys,
        ),
        RowRule(
            "TASK_PS_HIDDEN_001",
            runs & x.matches(command, fv.TASK_HIDDEN_PS),
            text(
                "Task '%s' runs PowerShell with evasion flags: %s", task, F.substring(command, 1, 120)
            ),
            extra=details,
            keys=((F.lit("scheduled_task"), F.lower(task)), keys[1]),
        ),
        RowRule(
            "TASK_MASQUERADE_001",
            is_task
            & x.matches(task, fv.TASK_MASQUERADE)
            & ~x.matches(c("original"), fv.TASK_LEGIT_PREFIX),
            text("Task '%s' mimics a system process but not in Microsoft path", task),
            extra=details,
            keys=keys,
        ),
        RowRule(
            "TASK_LOLBIN_001",
            runs & lolbin.isNotNull() & ~((lolbin == "rundll32") & ordinary_dll),
            text("Task '%s' uses LOLBin '%s': %s", task, lolbin, F.substring(command, 1, 120)),
            extra={
                "task_name": task,
                "lolbin": lolbin,
                "command": command,
                "state": c("action"),
            },
        ),
        RowRule(
            "WIN_SCHTASK_CREATED_001",
            (c("action") == "scheduled_task_created")
            & ~(x.matches(created_exe, fv.CREATED_TASK_LEGIT_PATH) & ~uses_com)
            & ~((created_name != "-") & x.matches(created_name, fv.CREATED_TASK_LEGIT_COM)),
            text("Suspicious scheduled task created: '%s'", created_name),
            extra={
                "task_name": created_name,
                "uses_com_handler": uses_com,
                "executable": created_exe,
                "command": command,
            },
            keys=((F.lit("task_name"), created_name),),
            severity=F.when(uses_com, F.lit("critical")).otherwise(F.lit("high")),
            confidence=F.when(uses_com, F.lit(0.93)).otherwise(F.lit(0.80)),
        ),
    ]


def wmi_rules() -> list[RowRule]:
    risky = x.matches(c("original"), fv.WMI_SUSPICIOUS)
    return [
        RowRule(
            "WMI_SUBSCRIPTION_001",
            (c("action") == "wmi_event_subscription_created")
            & ~x.matches(c("original"), fv.WMI_LEGITIMATE),
            text("WMI event subscription created by '%s'", c("user_name")),
            extra={
                "username": c("user_name"),
                "pid": c("pid"),
                "has_suspicious_content": risky,
                "raw": F.substring(c("original"), 1, 300),
            },
            entities={"host": c("host"), "user": c("user_name")},
            requires=((None, capability("code_execution", host=c("host"))),),
            provides=((None, capability("persistence", host=c("host"))),),
            severity=F.when(risky, F.lit("critical")).otherwise(F.lit("high")),
            confidence=F.when(risky, F.lit(0.97)).otherwise(F.lit(0.85)),
        )
    ]


def web_rules() -> list[RowRule]:
    url = c("url")
    has_url = c("has_url") & (url != "")
    post = F.coalesce(c("method") == "post", F.lit(False)) & has_url
    script = x.matches(url, fv.UPLOAD_SCRIPT_EXTENSION)
    odd_name = x.matches(url, fv.UPLOAD_NAME)
    upload_dir = x.matches(url, fv.UPLOAD_DIR)
    high_risk = x.matches(url, fv.UPLOAD_HIGH_RISK)
    command = x.url_command(url)
    body_command = x.body_command(c("body"))
    ip = c("src_ip")
    return [
        RowRule(
            "WEB_SQLI_001",
            has_url & x.matches(url, fv.SQL_INJECTION),
            text("SQL injection pattern detected in URL from %s", ip),
            extra=_web_extra(),
        ),
        RowRule(
            "WEB_LFI_001",
            has_url & x.matches(url, fv.PATH_TRAVERSAL),
            text("Path traversal detected in URL from %s", ip),
            extra=_web_extra(),
            entities=_web_entities(),
        ),
        RowRule(
            "WEB_CMDI_001",
            has_url & x.matches(url, fv.COMMAND_INJECTION),
            text("Command injection pattern detected from %s", ip),
            extra=_web_extra(),
            entities=_web_entities(),
        ),
        RowRule(
            "WEB_XSS_001",
            has_url & x.matches(url, fv.SCRIPT_INJECTION),
            text("XSS pattern detected in URL from %s", ip),
            extra=_web_extra(),
            entities=_web_entities(),
        ),
        RowRule(
            "WEB_WEBSHELL_UPLOAD_001",
            post & ((script & upload_dir) | (odd_name & script) | (odd_name & upload_dir)),
            text("Possible upload of webshell from %s: %s", ip, url),
            extra={
                **_web_extra(),
                "confidence_reason": F.when(script & upload_dir, F.lit("php_in_upload_dir"))
                .when(odd_name & script, F.lit("suspicious_name_with_ext"))
                .otherwise(F.lit("suspicious_name_in_upload_dir")),
            },
            entities=_web_entities(),
            provides=(
                (
                    None,
                    capability("webshell_dropped", source_ip=ip, file_name=x.url_file_name(url)),
                ),
            ),
            confidence=F.when(script & upload_dir, F.lit(0.95))
            .when(odd_name & script, F.lit(0.90))
            .otherwise(F.lit(0.80)),
        ),
        RowRule(
            # A request without a command that can be read gives no finding.
            "WEB_WEBSHELL_EXEC_001",
            has_url & x.matches(url, fv.WEBSHELL_COMMAND) & x.non_empty(command).isNotNull(),
            text("Execution of command via webshell from %s: %s", ip, url),
            extra=_web_extra(),
            entities={**_web_entities(), "command": command},
            requires=((None, capability("webshell_dropped", file_name=x.url_file_name(url))),),
            provides=((None, capability("web_command", command_line=command)),),
            keys=((F.lit("webshell_command"), command),),
        ),
        RowRule(
            "WEB_MALICIOUS_UPLOAD_001",
            post & x.matches(url, fv.UPLOAD_EXECUTABLE),
            text("Upload of malicious executable from %s: %s", ip, url),
            extra={**_web_extra(), "high_risk": high_risk},
            entities=_web_entities(),
            severity=F.when(high_risk, F.lit("critical")).otherwise(F.lit("high")),
            confidence=F.when(high_risk, F.lit(0.92)).otherwise(F.lit(0.80)),
        ),
        RowRule(
            "WEB_WEBSHELL_EXEC_002",
            post & c("body").isNotNull() & body_command.isNotNull(),
            text(
                "Suspicious command detected in POST body from %s to %s: %s", ip, url, body_command
            ),
            extra={**_web_extra(), "raw_body": c("body")},
            entities={**_web_entities(), "command": body_command},
            provides=((None, capability("web_command", command_line=body_command)),),
            keys=((F.lit("webshell_command"), body_command),),
        ),
    ]


def whole_channel_row_rules() -> list[RowRule]:
    """Two rules the catalogue files under "aggregate" although each looks at single events."""
    command = c("command")
    task = c("code")
    target = x.execution_target(c("executable"), c("args"))
    return [
        RowRule(
            "PROC_SUSPICIOUS_CMDLINE_001",
            c("has_process")
            & command.isNotNull()
            & x.matches(command, fv.SUSPICIOUS_COMMAND)
            & ~x.matches(c("process"), fv.WATCHED_PROCESS),
            text("Suspicious cmdline on '%s': '%s'", c("process"), F.substring(command, 1, 120)),
            extra={
                "process": c("process"),
                "pid": c("pid"),
                "command_line": command,
                "username": c("user_name"),
            },
            requires=((None, capability("code_execution", command_line=command)),),
            keys=((F.lit("command_execution"), F.lower(command)),),
        ),
        RowRule(
            "TASK_NON_SYSTEM_EXEC_001",
            F.coalesce(c("dataset") == fv.TASK_DATASET, F.lit(False))
            & command.isNotNull()
            & (c("action") != "disabled")
            & F.coalesce(target.rlike(r"[\\/]"), F.lit(False))
            & ~x.matches(target, fv.TASK_SYSTEM_PATH),
            text("Task '%s' runs from non-system path: %s", task, target),
            extra={
                "task_name": task,
                "executable": c("executable"),
                "target": target,
                "command": command,
                "state": c("action"),
            },
            keys=((F.lit("scheduled_task"), task), (F.lit("command_execution"), command)),
        ),
    ]


# Rule families by id prefix; a family is built only if one of its rules is wanted.
FAMILIES = (
    (("WIN_USER_", "WIN_GROUP_", "WIN_REMOTE_"), account_rules),
    (("NET_SUSPICIOUS_", "NET_REVERSE_", "NET_WEBSERVER_"), network_rules),
    (
        ("PROC_SUSPICIOUS_001", "PROC_WEBSHELL_", "WIN_SUSPICIOUS_", "WIN_CMD_"),
        process_rules,
    ),
    (("REG_",), registry_rules),
    (("WIN_LOG_",), evasion_rules),
    (("SYS_", "WIN_SENSITIVE_", "WIN_SYSTEM_"), file_rules),
    (
        ("TASK_WEBROOT_", "TASK_PS_", "TASK_MASQUERADE_", "TASK_LOLBIN_", "WIN_SCHTASK_"),
        task_rules,
    ),
    (("WMI_",), wmi_rules),
    (
        ("WEB_SQLI_", "WEB_LFI_", "WEB_CMDI_", "WEB_XSS_", "WEB_WEBSHELL_", "WEB_MALICIOUS_"),
        web_rules,
    ),
    (("PROC_SUSPICIOUS_CMDLINE_", "TASK_NON_SYSTEM_"), whole_channel_row_rules),
)


def default_row_rules(wanted: set[str] | None = None) -> list[RowRule]:
    """All row rules in catalogue order, or the wanted ones."""
    rules = []
    for prefixes, family in FAMILIES:
        if wanted is None or any(rule_id.startswith(prefixes) for rule_id in wanted):
            rules += [r for r in family() if wanted is None or r.rule_id in wanted]
    return rules
