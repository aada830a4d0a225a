"""Windows event logs to the event model: one projection per channel, routed by event id.

Input rows: ``collection_id, ord, time_created, event_id, message, event_data`` and, if the
collector gave them, ``computer, hostname, host``.  Ids without a parser are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.functions.events import Parser, build_events

c = F.col
lit = F.lit


def d(name: str) -> Column:
    """A member of the event data."""
    return c("event_data")[name]


def _event(
    action: str,
    category: str,
    dataset: str,
    module: str,
    *,
    provider: Column | None = None,
    severity: Column | int | None = None,
    timed: bool = False,
) -> Parser:
    created = x.iso_time(c("time_created"))
    parser: Parser = {
        "event.action": lit(action),
        "event.category": lit(category),
        "event.code": c("event_id").cast("string"),
        "event.created": created,
        "event.dataset": lit(dataset),
        "event.module": lit(module),
        "event.original": F.coalesce(c("message"), lit("")).cast("binary"),
        "winlog.event_id": c("event_id"),
    }
    if provider is not None:
        parser["event.provider"] = provider
    if severity is not None:
        parser["event.severity"] = severity if isinstance(severity, Column) else lit(severity)
    if timed:
        parser["timestamp"] = created
    return parser


def _winlog(channel: str, provider: str, **extra: Column) -> Parser:
    parser: Parser = {
        "winlog.channel": lit(channel),
        "winlog.provider_name": lit(provider),
    }
    if extra:
        parser["winlog.extra"] = x.string_map(**extra)
    return parser


def _image(prefix: str, pid: Column, image: Column, guid: Column | None = None) -> Parser:
    parser: Parser = {
        f"{prefix}.pid": pid,
        f"{prefix}.executable": x.basename(image),
        f"{prefix}.name": x.process_name(image),
    }
    if guid is not None:
        parser[f"{prefix}.entity_id"] = x.clean(guid)
    return parser


def _account(raw: Column, domain: bool = True) -> Parser:
    """User of a ``DOMAIN\\user`` text."""
    parser: Parser = {"user.name": x.basename(x.account_user(raw))}
    if domain:
        parser["user.domain"] = x.domain_name(x.account_domain(raw))
    return parser


def _named_account(prefix: str, sid: str | None = None) -> Parser:
    parser: Parser = {
        "user.name": x.basename(d(f"{prefix}UserName")),
        "user.domain": x.domain_name(d(f"{prefix}DomainName")),
    }
    if sid:
        parser["user.id"] = x.clean(d(sid))
    return parser


# ------------------------------------------------------------------ Sysmon
def sysmon_parsers() -> dict[int, Parser]:
    def event(action: str, category: str, severity: Column | int | None, timed: bool = False) -> Parser:
        own = _event(action, category, "windows_sysmon", "sysmon", severity=severity, timed=timed)
        return {**own, **{path: column for path, column in common.items() if path in own}, "event.provider": provider}

    def winlog(**extra: Column) -> Parser:
        return {**named, **({"winlog.extra": x.string_map(**extra)} if extra else {})}

    # Members that parsers set alike are one column each, so that their branches become one.
    common = _event("", "", "windows_sysmon", "sysmon", timed=True)
    for path in ("event.action", "event.category"):
        del common[path]
    provider = lit("Microsoft-Windows-Sysmon")
    named = _winlog("Microsoft-Windows-Sysmon/Operational", "Microsoft-Windows-Sysmon")
    user, source_user = _account(d("User")), _account(d("SourceUser"))

    pid, image, guid = x.pid(d("ProcessId")), d("Image"), d("ProcessGuid")
    process = _image("process", pid, image, guid)
    parent = _image(
        "process.parent", x.pid(d("ParentProcessId")), d("ParentImage"), d("ParentProcessGuid")
    )
    source = _image("process", x.pid(d("SourceProcessId")), d("SourceImage"), guid)
    target = _image("target.process", x.pid(d("TargetProcessId")), d("TargetImage"))
    args = F.slice(x.words(d("CommandLine")), lit(2), F.greatest(F.size(x.words(d("CommandLine"))) - 1, lit(0)))
    has_args = F.size(args) > 0
    target_file = {
        "file.path": x.clean(d("TargetFilename")),
        "file.name": x.basename(d("TargetFilename")),
    }
    pipe = F.coalesce(F.lower(x.strip(d("PipeName"))), lit(""))
    odd_pipe = x.any_of([pipe.contains(p) for p in fv.SUSPICIOUS_PIPES])

    def registry(action: str) -> Parser:
        return {
            **event(action, "registry", None),
            **user,
            **process,
            "registry.path": x.clean(d("TargetObject")),
            "registry.value": x.clean(d("Details")),
            **winlog(),
        }

    def pipe_event(action: str) -> Parser:
        return {
            **event(action, "ipc", F.when(odd_pipe, 5).otherwise(2)),
            **user,
            **process,
            **winlog(),
        }

    return {
        1: {
            **event("process_created", "process", 2),
            **user,
            **process,
            "process.command_line": x.command_line(d("CommandLine")),
            "process.args": x.clean_args(args),
            "process.args_count": F.when(has_args, F.size(args)),
            "process.hash_sha256": x.clean(d("Hashes")),
            **parent,
            "process.parent.command_line": x.command_line(d("ParentCommandLine")),
            "logon.id": x.logon_id(d("LogonId")),
            **winlog(),
        },
        3: {
            **event("network_connection", "network", 2, timed=True),
            **user,
            **process,
            "network.transport": x.clean(d("Protocol")),
            "network.direction": F.when(F.lower(d("Initiated")) == "true", lit("egress")).otherwise(
                lit("ingress")
            ),
            "source.ip": x.clean(d("SourceIp")),
            "source.port": x.port(d("SourcePort")),
            "destination.ip": x.clean(d("DestinationIp")),
            "destination.port": x.port(d("DestinationPort")),
            "destination.domain": x.clean(d("DestinationHostname")),
            **winlog(),
        },
        5: {**event("process_terminated", "process", 1), **process, **winlog()},
        7: {
            **event("image_loaded", "library", 2),
            "user.name": user["user.name"],
            **process,
            "file.path": x.clean(d("ImageLoaded")),
            "file.name": x.basename(d("ImageLoaded")),
            **winlog(hashes=x.clean(d("Hashes")), signature_status=x.clean(d("SignatureStatus"))),
        },
        8: {
            **event("create_remote_thread", "process", 4),
            "user.name": source_user["user.name"],
            **source,
            **target,
            **winlog(),
        },
        10: {
            **event(
                "process_access",
                "process",
                F.when(F.lower(d("TargetImage")).contains("lsass"), 5).otherwise(3),
            ),
            **source_user,
            **source,
            **target,
            **winlog(
                granted_access=x.clean(d("GrantedAccess")),
                call_trace=x.clean(d("CallTrace")),
                source_thread_id=x.clean(d("SourceThreadId")),
                target_user=x.clean(d("TargetUser")),
            ),
        },
        11: {
            **event("file_created", "file", 2),
            **user,
            **process,
            **parent,
            **target_file,
            "file.created": x.iso_time(d("CreationUtcTime")),
            **winlog(),
        },
        12: registry("registry_key_created"),
        13: registry("registry_value_set"),
        17: pipe_event("pipe_created"),
        18: pipe_event("pipe_connected"),
        22: {
            **event("dns_query", "network", 1),
            **user,
            **process,
            "dns.question.name": x.clean(d("QueryName")),
            "dns.question.type": lit("A"),
            "dns.answers": x.dns_answers(d("QueryResults")),
            "dns.response_code": x.clean(d("QueryStatus")),
            **winlog(),
        },
        26: {
            **event("file_deleted", "file", 2),
            **user,
            **process,
            **target_file,
            "logon.id": x.logon_id(d("LogonId")),
            **winlog(
                hashes=x.clean(d("Hashes")),
                is_executable=x.clean(d("IsExecutable")),
                archived=x.clean(d("Archived")),
            ),
        },
    }


# ------------------------------------------------------------------ Security
def security_parsers() -> dict[int, Parser]:
    auditing = lit("Microsoft-Windows-Security-Auditing")

    def event(action: str, category: str, severity: int | None, provider: bool = True) -> Parser:
        return {
            **_event(
                action,
                category,
                "windows_security",
                "windows",
                provider=auditing if provider else None,
                severity=severity,
                timed=True,
            ),
            "winlog.channel": lit("Security"),
            "winlog.provider_name": auditing,
        }

    def logon(action: str) -> Parser:
        return {
            **event(action, "authentication", 1, provider=False),
            **_named_account("Target", "TargetUserSid"),
            "host.name": x.clean(d("WorkstationName")),
            "source.ip": x.clean(d("IpAddress")),
            "source.port": x.port(d("IpPort")),
            **_image("process", x.hex_to_int(d("ProcessId")), d("ProcessName")),
            "logon.id": x.logon_id(d("TargetLogonId")),
            "logon.type": x.clean(d("LogonType")),
        }

    command, args = c("_command"), c("_args")

    def task_event(action: str, severity: int | None) -> Parser:
        return {
            **event(action, "persistence", severity),
            **_named_account("Subject", "SubjectUserSid"),
            "host.hostname": x.clean(d("FQDN")),
            "process.pid": x.pid(d("ClientProcessId")),
            "process.parent.pid": x.pid(d("ParentProcessId")),
        }

    task_command, task_args, task_class = c("_task_command"), c("_task_args"), c("_task_class")
    task_text = x.clean(d("TaskName"))
    full = c("_task_line")
    return {
        4624: logon("account_logged_on"),
        # Failed logons have the shape of successful ones.
        4625: logon("logon_failed"),
        4688: {
            **event("process_created", "process", 1, provider=False),
            **_named_account("Subject", "SubjectUserSid"),
            **_image("process", x.hex_to_int(d("NewProcessId")), d("NewProcessName")),
            "process.command_line": command,
            "process.args": args,
            "process.args_count": F.when(command.isNull(), 0).otherwise(F.size(args)),
            **_image("process.parent", x.hex_to_int(d("ProcessId")), d("ParentProcessName")),
        },
        4698: {
            **task_event("scheduled_task_created", None),
            "process.executable": x.basename(task_command),
            "process.args": task_args,
            "process.command_line": x.command_line(full),
            "winlog.extra": x.string_map(
                task_name=x.task_name(task_text),
                uses_com_handler=task_class.isNotNull(),
                com_class=x.clean(task_class),
                command=x.clean(full),
            ),
        },
        4702: {
            **task_event("scheduled_task_updated", 1),
            "process.executable": x.basename(F.coalesce(task_command, task_class)),
            "process.args": task_args,
            "process.command_line": x.command_line(task_text),
        },
        4720: {
            **event("user_account_created", "iam", 3),
            **_named_account("Target", "TargetSid"),
        },
        4732: {
            **event("user_added_to_group", "iam", None),
            **_named_account("Subject", "SubjectUserSid"),
            "group.name": x.clean(d("TargetUserName")),
            "group.domain": x.domain_name(d("TargetDomainName")),
            "group.id": x.clean(d("TargetSid")),
            "group.member_id": x.clean(d("MemberSid")),
            "group.member_name": x.clean(d("MemberName")),
        },
    }


def security_parts() -> list[dict[str, Column]]:
    """Command lines and task definitions, each taken apart once."""
    code = c("event_id")

    def task(xml: Column) -> Column:
        return x.xml_texts(xml, ("Exec", "Command"), ("Exec", "Arguments"), ("ComHandler", "ClassId"))

    texts = c("_task")
    return [
        {
            "_command": F.when(code == 4688, x.command_line(d("CommandLine"))),
            "_task": F.when(code == 4698, task(d("TaskContent"))).when(code == 4702, task(d("TaskContentNew"))),
        },
        {
            "_args": x.quoted_args(c("_command")),
            "_task_command": x.non_empty(F.get(texts, lit(0))),
            "_task_args": x.clean_args(x.words(F.get(texts, lit(1)))),
            "_task_class": x.non_empty(F.get(texts, lit(2))),
        },
        {
            "_task_line": F.when(
                c("_task_args").isNotNull(),
                F.concat_ws(" ", F.coalesce("_task_command", lit("None")), F.array_join("_task_args", " ")),
            ).otherwise(c("_task_command")),
        },
    ]


# ------------------------------------------------------------------ System
def system_parsers() -> dict[int, Parser]:
    def event(action: str, category: str, severity: Column | int | None, provider: str) -> Parser:
        return _event(
            action, category, "windows_system", "system", provider=lit(provider), severity=severity
        )

    kernel = F.lower(F.coalesce(d("ServiceType"), lit(""))).contains("kernel")
    return {
        7045: {
            **event(
                "service_installed", "host", F.when(kernel, 4).otherwise(3), "Service Control Manager"
            ),
            **_account(d("AccountName")),
            **_winlog(
                "System",
                "Service Control Manager",
                service_name=x.clean(d("ServiceName")),
                service_file_path=x.clean(d("ImagePath")),
                service_type=x.clean(d("ServiceType")),
                start_type=x.clean(d("StartType")),
            ),
        },
        104: {
            **event("log_cleared", "host", 5, "Microsoft-Windows-Eventlog"),
            **_named_account("Subject"),
            **_winlog(
                "System",
                "Microsoft-Windows-Eventlog",
                channel_cleared=x.clean(d("Channel")),
                backup_path=x.clean(d("BackupPath")),
            ),
        },
        4720: {
            **event("user_account_created", "iam", 3, "Microsoft-Windows-Security-Auditing"),
            **_named_account("Target"),
            **_winlog(
                "Security",
                "Microsoft-Windows-Security-Auditing",
                privileges=x.clean(d("PrivilegeList")),
                created_by=x.basename(d("SubjectUserName")),
            ),
        },
        20: {
            **event(
                "installation_failed", "configuration", 3, "Microsoft-Windows-WindowsUpdateClient"
            ),
            **_winlog(
                "System",
                "Microsoft-Windows-WindowsUpdateClient",
                update_title=x.clean(d("updateTitle")),
                error_code=x.clean(d("errorCode")),
                update_guid=x.clean(d("updateGuid")),
                revision_number=x.clean(d("updateRevisionNumber")),
            ),
        },
        10016: {
            **event("dcom_permission_error", "iam", None, "Microsoft-Windows-Distributed"),
            "user.name": x.basename(d("param7")),
            "user.domain": x.domain_name(d("param6")),
            "user.id": x.clean(d("param8")),
            **_winlog(
                "System",
                "Microsoft-Windows-DistributedCOM",
                component=x.clean(d("param4")),
                permission_type=x.clean(d("param3")),
                access_type=x.clean(d("param2")),
                address=x.clean(d("param9")),
                clsid=x.clean(d("param4")),
            ),
        },
    }


# ------------------------------------------------------------------ PowerShell
def powershell_parsers() -> dict[int, Parser]:
    def event(action: str, **extra: Column) -> Parser:
        return {
            **_event(
                action,
                "process",
                "windows_powershell",
                "powershell",
                provider=lit("Microsoft-Windows-PowerShell"),
            ),
            **_winlog(
                "Microsoft-Windows-PowerShell/Operational", "Microsoft-Windows-PowerShell", **extra
            ),
        }

    def invocation(action: str) -> Parser:
        return {
            **event(action),
            "host.hostname": x.clean(c("hostname")),
            "powershell.script_block_id": x.clean(d("ScriptBlockId")),
            "powershell.runspace_id": x.clean(d("RunspaceId")),
        }

    script = F.coalesce(x.clean(d("ScriptBlockText")), lit(""))
    return {
        4103: event(
            "powershell_pipeline_execution",
            command_invocation=x.clean(d("ContextInfo")),
            payload=x.clean(d("Payload")),
        ),
        # The script-block members are filled here too, the rules read them there.
        4104: {
            **event(
                "scriptblock-logged",
                script_block_text=script,
                script_block_id=x.clean(d("ScriptBlockId")),
                path=x.clean(d("Path")),
            ),
            "user.name": x.basename(d("UserId")),
            "powershell.script_block_id": x.clean(d("ScriptBlockId")),
            "powershell.script_block_text": script,
        },
        4105: invocation("scriptblock-started"),
        4106: invocation("scriptblock-completed"),
    }


# ------------------------------------------------------------------ WMI
def wmi_parsers() -> dict[int, Parser]:
    message = F.coalesce(c("message"), lit(""))
    kv = c("_values")

    def event(action: str, category: str, provider: Column) -> Parser:
        return {
            **_event(action, category, "windows.wmi", "windows", provider=provider, severity=1),
            **_winlog(
                "Microsoft-Windows-WMI-Activity/Operational", "Microsoft-Windows-WMI-Activity"
            ),
        }

    def account(raw: Column) -> Parser:
        return {
            "user.name": x.basename(x.account_user(raw)),
            "user.domain": x.domain_name(x.account_domain(raw)),
        }

    sentence = F.substring_index(message, ".", 1)
    started = r"(?d)^(.+?) provider started with result code (0x[0-9a-fA-F]+)"
    machine = x.clean(kv["ClientMachine"])
    query_machine = x.clean(x.group(message, r"ClientMachine\s*=\s*([^;]+)", flags=""))
    consumer = F.coalesce(kv["Consumer"], lit(""))
    sid_list = x.group(kv["PossibleCause"], r"CreatorSID\s*=\s*\{([^}]+)\}", flags="")
    sid_bytes = F.transform(F.split(x.strip(sid_list), ","), lambda b: x.strip(b).try_cast("int"))
    return {
        5857: {
            **event(
                "wmi_provider_start",
                "configuration",
                x.clean(x.group(sentence, started, flags="")),
            ),
            "process.name": x.process_name(kv["HostProcess"]),
            "process.pid": x.pid(kv["ProcessID"]),
            "process.executable": x.clean(kv["ProviderPath"]),
            "winlog.extra": x.string_map(result_code=x.clean(x.group(sentence, started, 2, flags=""))),
        },
        5858: {
            **event(
                "wmi_query_error", "configuration", lit("Microsoft-Windows-WMI-Activity")
            ),
            **account(kv["User"]),
            "host.hostname": machine,
            "process.pid": x.pid(kv["ClientProcessId"]),
            "winlog.computer_name": machine,
        },
        5859: {
            **event(
                "wmi_notification_query",
                "configuration",
                x.clean(F.substring_index(kv["Provider"], ",", 1)),
            ),
            "process.pid": x.pid(kv["HostProcessID"]),
            "user.id": x.clean(kv["OwnerName"]),
        },
        5860: {
            **event("wmi_subscription_query", "configuration", lit("WMI Subscription")),
            **account(kv["UserName"]),
            "host.hostname": query_machine,
            "process.pid": x.pid(x.group(message, r"ClientProcessID\s*=\s*(\d+)", flags="")),
            "winlog.computer_name": query_machine,
        },
        5861: {
            **event("wmi_event_subscription_created", "persistence", lit("WMI Event Log Binding")),
            "user.id": x.sid_from_bytes(sid_bytes),
            "process.name": x.process_name(x.clean(x.group(consumer, r"^([^=]+)", flags=""))),
            "process.entity_id": x.clean(x.group(consumer, r'="?([^"]+)"?', flags="")),
        },
    }


def wmi_parts() -> list[dict[str, Column]]:
    """The values of a message, read once; a provider start has them after its first sentence."""
    message = F.coalesce(c("message"), lit(""))
    rest = F.regexp_extract(message, r"(?s)^[^.]*\.(.*)$", 1)
    return [{"_values": x.key_values(F.when(c("event_id") == 5857, rest).otherwise(message))}]


# ------------------------------------------------------------------ Application
def application_parsers() -> dict[int, Parser]:
    def event(action: str, category: str, provider: str, **extra: Column) -> Parser:
        return {
            **_event(
                action, category, "windows.application", "application", provider=lit(provider)
            ),
            **_winlog("Application", provider, **extra),
        }

    runtime = "Microsoft-Windows-AppModel-Runtime"
    return {
        23: event(
            "app_repair_triggered",
            "application",
            runtime,
            operation=x.clean(d("Operation")),
            package_family=x.clean(d("PackageFamily")),
            operation_error=x.clean(d("OperationError")),
        ),
        24: event(
            "app_repair_finished",
            "application",
            runtime,
            operation=x.clean(d("Operation")),
            package_family=x.clean(d("PackageFamily")),
            repair_trigger_error=x.clean(d("RepairTriggerError")),
            operation_error=x.clean(d("OperationError")),
        ),
        8198: event(
            "software_protection_service_error",
            "iam",
            "Microsoft-Windows-Security-SPP",
            error_code=x.clean(F.coalesce(x.non_empty(d("Hr")), d("ErrorCode"))),
            hr=x.clean(d("Hr")),
            event_context=F.to_json("event_data"),
        ),
    }


PARSERS = {
    "sysmon": sysmon_parsers,
    "security": security_parsers,
    "system": system_parsers,
    "powershell": powershell_parsers,
    "wmi": wmi_parsers,
    "application": application_parsers,
}

#: Columns that several members of an event are made of, in steps; each step reads those before it.
PARTS = {"security": security_parts, "wmi": wmi_parts}

_OPTIONAL = ("computer", "hostname", "host")


def normalize_log(raw: DataFrame, channel: str) -> DataFrame:
    """Normalised events of one Windows log channel."""
    for name in _OPTIONAL:
        if name not in raw.columns:
            raw = raw.withColumn(name, x.null_string())
    if "event_data" not in raw.columns:
        raw = raw.withColumn("event_data", F.lit(None).cast("map<string,string>"))
    parsers = PARSERS[channel]()
    raw = raw.where(c("event_id").isin(*parsers))
    variants = [(c("event_id") == code, parser) for code, parser in parsers.items()]
    if channel == "sysmon":
        # No parser of this channel names the host; the raw record may.
        host = F.coalesce(
            *[x.clean(c(name)) for name in _OPTIONAL], x.clean(d("Computer")), x.clean(d("Hostname"))
        )
        variants.append((host.isNotNull(), {"host.name": host}))
    for step in PARTS.get(channel, list)():
        raw = raw.withColumns(step)
    original = F.to_json(F.struct("time_created", "event_id", "message", "event_data"))
    return build_events(raw, channel, variants, original)


def unparsed(raw: DataFrame, channel: str) -> DataFrame:
    """Count of raw events per id that no parser takes."""
    known = list(PARSERS[channel]())
    return (
        raw.where(c("event_id").isNull() | ~c("event_id").isin(*known))
        .groupBy("collection_id", "event_id")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )
