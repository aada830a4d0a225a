"""The registered queries in DuckDB SQL, over the same whole tables."""

from __future__ import annotations

from casegraph import fixed_values as fv
from casegraph.workloads import adapters as ad


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(index: str, values: list[str]) -> str:
    return f"({arr(values)})[CAST({index} AS INT) + 1]"


def rx(column: str, pattern: str, flags: str = "i") -> str:
    return f"coalesce(regexp_matches({column}, {q(pattern)}, {q(flags)}), false)"


def grp(column: str, pattern: str, flags: str = "i", index: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {q(pattern)}, {index}, {q(flags)}), '')"


def base(column: str) -> str:
    return f"nullif(regexp_extract(lower(trim({column})), '([^\\\\/]*)$', 1), '')"


SEV = arr(fv.SEVERITIES)
_META = {row[0]: row for row in fv.RULE_CATALOG}

WEB = f"""
web AS (
  SELECT *, {pick("k % 10", ad.URL_PAYLOADS)} AS attack_url, {pick("k % 5", ad.BODY_PAYLOADS)} AS body,
    {pick("user_id % 7", ad.AGENTS)} AS agent
  FROM (
    SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
      '10.' || (user_id // 65536) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS ip,
      CASE WHEN event_type = 'error' THEN 404
        WHEN event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 401
        WHEN event_type IN ('signup', 'purchase') THEN 302 ELSE 200 END AS status,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'post' ELSE 'get' END AS method,
      CASE WHEN event_type = 'signup' THEN '/login.php'
        ELSE '/p/' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) END AS path
    FROM events))
"""

# First command of a form body that has both a command word and a metacharacter.
BODY_COMMAND = f"""
  (list_filter(
    list_transform(
      list_filter(string_split(b, '&'), lambda p: regexp_matches(p, '^[^=]*=.+')),
      lambda p: trim(url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')))),
    lambda v: regexp_matches(v, {q(fv.BODY_COMMAND)}, 'i')
      AND regexp_matches(v, {q(fv.BODY_METACHARACTER_CS)})))[1]
"""

URL_FILE_PARTS = "coalesce(" + ", ".join(
    f"CASE WHEN contains(regexp_extract(url_decode(regexp_extract(qs, '(?:^|&){p}=([^&]+)', 1)), '([^/]*)/*$', 1), '.')"
    f" THEN regexp_extract(url_decode(regexp_extract(qs, '(?:^|&){p}=([^&]+)', 1)), '([^/]*)/*$', 1) END"
    for p in fv.FILE_PARAMS
) + ", CASE WHEN contains(regexp_extract(p, '([^/]*)/*$', 1), '.') THEN regexp_extract(p, '([^/]*)/*$', 1) END)"

URL_COMMAND = "coalesce(" + ", ".join(
    f"nullif(url_decode(replace(regexp_extract(qs, '(?:^|&){p}=([^&]+)', 1), '+', ' ')), '')"
    for p in fv.COMMAND_PARAMS
) + ")"

URLS = f"""
urls AS (
  SELECT event_id AS ord, ip, method, status, url, {URL_FILE_PARTS} AS file_name, {URL_COMMAND} AS command,
    CASE WHEN method = 'post' THEN body END AS b
  FROM (
    SELECT *, lower(attack_url) AS url, regexp_extract(lower(attack_url), '\\?(.*)$', 1) AS qs,
      regexp_replace(split_part(lower(attack_url), '?', 1), ';[^/]*$', '') AS p
    FROM web))
"""

PROC = f"""
proc0 AS (
  SELECT o_orderkey AS ord, o_custkey, o_orderdate,
    {pick("o_orderkey % 7", ad.IMAGES)} AS image, {pick("o_orderkey % 11", ad.COMMANDS)} AS raw_command,
    {pick("o_custkey % 5", ad.PARENTS)} AS parent_image
  FROM orders),
proc AS (
  SELECT *, {base("image")} AS process, {base("parent_image")} AS parent,
    nullif(coalesce({grp("lower(raw_command)", '^cmd(?:.exe)?[ ]+/c[ ]+"(.+)"$')}, lower(raw_command)), '') AS command
  FROM proc0)
"""

FILES = f"""
files AS (
  SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey, l_linenumber,
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS sec,
    CASE WHEN l_partkey % 4 = 0 THEN 11 ELSE 26 END AS code,
    {base(pick("l_partkey % 7", ad.IMAGES))} AS process,
    lower({pick("(l_partkey + l_suppkey) % 9", ad.FILES)}) AS path,
    CASE WHEN l_orderkey % 3 <> 0 THEN '0x' || lower(to_hex(l_orderkey + 4096)) END AS logon_id,
    '{{p-' || l_orderkey || '}}' AS guid
  FROM lineitem)
"""

SEC = f"""
sec AS (
  SELECT o_orderkey AS ord, o_custkey AS u, o_orderkey % 5 AS kind, o_orderdate AS t,
    CASE WHEN o_orderkey % 5 = 4 THEN lower({pick("o_custkey % 3", ["Administrators", "Users", "Remote Desktop Users"])})
      ELSE 'user' || (o_custkey % 400) END AS target,
    CASE WHEN o_custkey % 50 = 0 THEN 's-1-5-18' ELSE 's-1-5-21-' || o_custkey END AS sid,
    {pick("o_custkey % 4", ["2", "3", "10", "x"])} AS ltype
  FROM orders)
"""

TCP = f"""
tcp AS (
  SELECT c_custkey AS ord, 'tcp_' || lower({pick("c_nationkey % 4", ad.SOCKET_STATES)}) AS action,
    CASE WHEN c_custkey % 13 = 0 THEN '127.0.0.1' ELSE '10.2.0.' || (c_custkey % 250) END AS src_ip,
    CAST({pick("c_custkey % 9", ad.SOCKET_PORTS)} AS INT) AS src_port,
    CASE WHEN c_custkey % 11 = 0 THEN '::1' ELSE '172.16.0.' || (c_custkey % 199) END AS dst_ip,
    CAST({pick("(c_custkey + c_nationkey) % 9", ad.SOCKET_PORTS)} AS INT) AS dst_port,
    nullif(c_custkey % 3000, 0) AS pid,
    lower({pick("c_custkey % 7", ad.SOCKET_PROCESSES)}) AS process
  FROM customer)
"""

REG = f"""
reg AS (
  SELECT p_partkey AS ord, lower({pick("p_partkey % 5", ad.REGISTRY_KEYS)}) AS path,
    lower({pick("p_partkey % 4", ad.SERVICE_NAMES)}) AS value, lower({pick("p_partkey % 7", ad.REGISTRY_DATA)}) AS data
  FROM part)
"""

# The expected split of each task action, by position in the list of actions.
_TASK_EXE = ["run.bat", "powershell.exe", "rundll32.exe", "rundll32.exe", "rundll32.exe", "app.exe", "certutil.exe", "cmd", "tool.exe"]
_TASK_ARGS = [
    None, "-noprofile -file c:\\scripts\\a.ps1", "shell32.dll,control", "c:\\windows\\system32\\x.dll", "sysmain.dll,run",
    "--quiet", "-decode a b", "/c d:/tools/job.cmd", "-x -y",
]
_TASK_NAME = ["updater", "backup", "svchost", "windows update", "cleaner"]
_ARGS_SQL = "([" + ", ".join("NULL" if a is None else q(a) for a in _TASK_ARGS) + "])[CAST(p_partkey % 9 AS INT) + 1]"

TASK = f"""
task AS (
  SELECT p_partkey AS ord, {pick("p_partkey % 5", _TASK_NAME)} AS task, (1600000000000 + p_partkey * 1000) * 1000 AS last_run_us,
    {pick("p_partkey % 9", _TASK_EXE)} AS executable, {_ARGS_SQL} AS args,
    lower({pick("p_partkey % 9", ad.TASK_ACTIONS)}) AS command
  FROM part)
"""


def rule_rows(cte: str, source: str, rules: list[tuple], key: str = "ord") -> str:
    """UNION of single-rule selects; a rule is (id, predicate[, severity, confidence, technique])."""
    selects = []
    for rule in rules:
        meta = _META[rule[0]]
        severity = rule[2] if len(rule) > 2 and rule[2] else q(meta[3] or "")
        confidence = rule[3] if len(rule) > 3 and rule[3] else str(meta[4])
        technique = rule[4] if len(rule) > 4 and rule[4] else q(meta[5] or "")
        selects.append(
            f"SELECT {q(rule[0])} AS rule_id, CAST({key} AS BIGINT) AS event_ord, {severity} AS severity, "
            f"CAST({confidence} AS DOUBLE) AS confidence, {technique} AS technique_id, {q(meta[8])} AS kill_chain_phase "
            f"FROM {source} WHERE {rule[1]}"
        )
    return f"WITH {cte} " + " UNION ALL ".join(selects)


_POST = "method = 'post'"
_SCRIPT, _ODD, _DIR = rx("url", fv.UPLOAD_SCRIPT_EXTENSION), rx("url", fv.UPLOAD_NAME), rx("url", fv.UPLOAD_DIR)
_RISK = rx("url", fv.UPLOAD_HIGH_RISK)
_CMD = rx("command", fv.SUSPICIOUS_COMMAND)
_WATCHED = rx("process", fv.WATCHED_PROCESS)
_WEBPARENT = rx("parent", fv.WEB_SERVER_PARENT)
_FIRST = "regexp_extract(command, '^(\\S+)', 1)"
_INSTALLER = (
    f"(command IS NOT NULL AND ({rx('parent_image', fv.INSTALLER_PARENT)} OR "
    f"({rx('process', fv.XAMPP_TOOL)} AND {rx('command', fv.XAMPP_PATH)}) OR "
    f"({rx('process', fv.CMD_WRAPPER)} AND {rx(grp(_FIRST, fv.FIRST_EXE), fv.XAMPP_TOOL)} AND {rx('command', fv.XAMPP_PATH)}) OR "
    f"{rx('command', fv.BENIGN_PHP_PROBE)}))"
)
_DIRECT = "process NOT IN ('cmd.exe', 'powershell.exe')"
_NEWUSER = grp("command", fv.NET_USER_ADD, "is")
_NEWTASK = grp("command", fv.SCHTASKS_CREATE, "is")
_NEWRUN = grp("command", fv.REG_RUN_ADD, "is")
_LISTENER = rx("process", fv.LISTENER_PROCESS)
_PORTS = "(" + ", ".join(map(str, fv.SUSPICIOUS_PORTS)) + ")"
_BOUND = "(contains(action, 'bound') AND NOT contains(action, 'listen'))"
_INPATH, _INWEB, _HID = rx("data", fv.RUN_DATA_PATH), rx("data", fv.RUN_DATA_WEB_PATH), rx("data", fv.RUN_DATA_COMMAND)
_SENS = rx("path", fv.SENSITIVE_EXTENSION)
_LOLBIN = f"lower(coalesce({grp('executable', fv.TASK_LOLBIN)}, {grp('command', fv.TASK_LOLBIN)}))"
_TARGET = f"coalesce(nullif(trim(split_part(args, ',', 1)), ''), {grp('command', fv.RUNDLL_TARGET)})"
_ORDINARY = (
    f"({rx('coalesce(args, command)', fv.WINDOWS_DIR)} OR {rx(_TARGET, '[/' + chr(92) * 2 + ']', '')} OR {rx(_TARGET, fv.KNOWN_SYSTEM_DLL)})"
)

ORACLES: dict[str, str] = {
    "channel_counts": "SELECT event_type AS channel, count(*) AS events FROM events GROUP BY 1",
    "lookback_filter": "SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS first_us FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' GROUP BY 1",
    "merged_new_events": """
        WITH b AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT o_orderkey, o_orderstatus FROM b UNION ALL
        SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (
          SELECT 1 FROM b WHERE b.o_orderdate = o.o_orderdate AND b.o_custkey = o.o_custkey)""",
    "oldest_per_log": "SELECT event_type, epoch_us(min(ts)) AS oldest_us FROM events GROUP BY 1",
    "access_log_lines": f"""
        WITH {WEB} SELECT event_id AS ord, epoch_us(date_trunc('second', ts)) AS at_us, ip, method, status,
          lower(agent) AS agent, path FROM web WHERE k % 17 <> 0""",
    "access_lines_since": "SELECT count(*) AS n, min(event_id) AS first_ord FROM events "
    "WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-15 00:00:00'",
    # ------------------------------------------------------------ normalisation
    "normalized_processes": f"""
        WITH {PROC} SELECT ord, epoch_us(o_orderdate) + (ord % 86400) * 1000000 AS created_us,
          'process_created' AS action, 2 AS severity, 'user' || o_custkey AS user_name, 'corp' AS user_domain, process,
          ord % 5000 AS pid, command,
          nullif(len(list_filter(string_split(trim(raw_command), ' '), lambda w: w <> '')) - 1, 0)::INT AS args_count0,
          '{{g-' || ord || '}}' AS guid, parent, '{{g-' || (ord // 2) || '}}' AS parent_guid,
          '0x' || lower(to_hex(o_custkey)) AS logon_id FROM proc""",
    "normalized_files": f"""
        WITH {FILES} SELECT ord, CASE WHEN code = 11 THEN 'file_created' ELSE 'file_deleted' END AS action, path,
          regexp_extract(path, '([^\\\\/]*)$', 1) AS name, CASE WHEN code = 26 THEN logon_id END AS logon_id FROM files""",
    "normalized_security": f"""
        WITH {SEC} SELECT ord,
          CASE WHEN kind = 0 THEN 'account_logged_on' WHEN kind <= 2 THEN 'logon_failed'
            WHEN kind = 3 THEN 'user_account_created' ELSE 'user_added_to_group' END AS action,
          CASE WHEN kind < 4 THEN target END AS user_name, CASE WHEN kind < 4 THEN 'corp' END AS user_domain,
          CASE WHEN kind < 4 THEN sid END AS user_id, CASE WHEN kind <= 2 THEN '10.1.0.' || (u % 200) END AS ip,
          CASE WHEN kind <= 2 THEN u % 4096 END AS pid,
          CASE WHEN kind <= 2 THEN '0x' || lower(to_hex(ord + 16)) END AS logon_id,
          CASE WHEN kind <= 2 THEN ltype END AS logon_type, CASE WHEN kind = 4 THEN target END AS group_name,
          CASE WHEN kind = 4 AND u % 7 <> 0 THEN sid END AS member_id FROM sec""",
    "normalized_wmi": f"""
        SELECT c_custkey AS ord, 'wmi_event_subscription_created' AS action,
          CASE WHEN c_custkey % 3 = 0 THEN 'S-1-5-21-513-7-8-500' END AS sid,
          {pick("c_custkey % 3", ["commandlineeventconsumer", "nteventlogeventconsumer", "activescripteventconsumer"])} AS consumer_type,
          {pick("c_custkey % 3", ["evil", "scm event log consumer", "plain"])} AS consumer_name FROM customer""",
    "normalized_network": f"""
        WITH {TCP} SELECT ord, action, src_ip, src_port, dst_port, pid, process, NULL::VARCHAR AS mac FROM tcp UNION ALL
        SELECT s_suppkey + 1000000000, 'arp_cache_entry', NULL, NULL, NULL, NULL, NULL,
          CASE WHEN s_suppkey % 10 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE 'aa:00:00:00:' || s_nationkey || ':' || (s_suppkey % 2) END
        FROM supplier""",
    "normalized_tasks": f"WITH {TASK} SELECT ord * 4294967296 AS ord, task, last_run_us, executable, args, command FROM task",
    "normalized_registry": f"""
        WITH {REG} SELECT ord, path, data,
          CASE WHEN contains(path, 'services') THEN {pick("ord % 7", ["a.exe", "b.exe", "powershell", "powershell.exe", "ok.exe", "svc.exe", "rundll32"])} END AS executable,
          CASE WHEN contains(path, 'services') THEN ([0, 0, 4, 2, 0, 2, 1])[CAST(ord % 7 AS INT) + 1] END AS args_count FROM reg""",
    "probe_tags": f"WITH {TCP} SELECT ord, dst_ip FROM tcp WHERE dst_ip IN (SELECT '172.16.0.' || r_regionkey FROM region)",
    "reassembled_requests": """
        WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\\\\\\r\\n\\t"]', ' ', 'g') AS t FROM conversations),
        w AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS body FROM t GROUP BY 1)
        SELECT '10.9.0.1:' || (conv_id % 13) AS client, 'post' AS method0, '/c/' || conv_id AS path,
          strlen(body)::BIGINT AS body_bytes, md5(body) AS body_md5 FROM w""".replace("'post' AS method0", "'POST' AS method"),
    # ------------------------------------------------------------ expressions
    "url_fields": f"WITH {WEB}, {URLS} SELECT ord, url, file_name, command FROM urls",
    "body_commands": f"WITH {WEB}, {URLS} SELECT ord, {BODY_COMMAND} AS command FROM urls WHERE b IS NOT NULL",
    # ------------------------------------------------------------ row rules
    "web_row_rules": rule_rows(
        f"{WEB}, {URLS}, u AS (SELECT *, {BODY_COMMAND} AS body_command FROM urls)",
        "u",
        [
            ("WEB_SQLI_001", rx("url", fv.SQL_INJECTION)),
            ("WEB_LFI_001", rx("url", fv.PATH_TRAVERSAL)),
            ("WEB_CMDI_001", rx("url", fv.COMMAND_INJECTION)),
            ("WEB_XSS_001", rx("url", fv.SCRIPT_INJECTION)),
            (
                "WEB_WEBSHELL_UPLOAD_001",
                f"{_POST} AND (({_SCRIPT} AND {_DIR}) OR ({_ODD} AND {_SCRIPT}) OR ({_ODD} AND {_DIR}))",
                None,
                f"CASE WHEN {_SCRIPT} AND {_DIR} THEN 0.95 WHEN {_ODD} AND {_SCRIPT} THEN 0.90 ELSE 0.80 END",
            ),
            ("WEB_WEBSHELL_EXEC_001", f"{rx('url', fv.WEBSHELL_COMMAND)} AND command IS NOT NULL"),
            (
                "WEB_MALICIOUS_UPLOAD_001",
                f"{_POST} AND {rx('url', fv.UPLOAD_EXECUTABLE)}",
                f"CASE WHEN {_RISK} THEN 'critical' ELSE 'high' END",
                f"CASE WHEN {_RISK} THEN 0.92 ELSE 0.80 END",
            ),
            ("WEB_WEBSHELL_EXEC_002", f"{_POST} AND body_command IS NOT NULL"),
        ],
    ),
    "process_row_rules": rule_rows(
        PROC,
        "proc",
        [
            ("PROC_SUSPICIOUS_001", f"{_WATCHED} AND {_CMD}"),
            ("PROC_WEBSHELL_CHILD_001", f"{_WATCHED} AND {_WEBPARENT} AND NOT {_INSTALLER}"),
            ("WIN_SUSPICIOUS_CMDLINE_001", f"{_CMD} AND NOT {_WEBPARENT}"),
            ("WIN_CMD_USER_CREATION_001", f"process IN ('net.exe', 'net1.exe') AND {_NEWUSER} IS NOT NULL"),
            (
                "WIN_CMD_PERSISTENCE_ARTIFACT_001",
                f"{_DIRECT} AND ({_NEWTASK} IS NOT NULL OR {_NEWRUN} IS NOT NULL)",
                None,
                None,
                f"CASE WHEN {_NEWTASK} IS NOT NULL THEN 'T1053.005' ELSE 'T1547.001' END",
            ),
            ("PROC_SUSPICIOUS_CMDLINE_001", f"{_CMD} AND NOT {_WATCHED}"),
        ],
    ),
    "network_row_rules": rule_rows(
        TCP,
        "tcp",
        [
            ("NET_SUSPICIOUS_LISTENER_001", f"{_LISTENER} AND src_port <= 49152 AND NOT {_BOUND}"),
            ("NET_SUSPICIOUS_PORT_001", f"src_port IN {_PORTS}"),
            ("NET_REVERSE_SHELL_001", f"{_LISTENER} AND dst_port IN {_PORTS}"),
            ("NET_SUSPICIOUS_OUTBOUND_001", f"{_LISTENER} AND dst_port IN {_PORTS} AND NOT {_BOUND}"),
            (
                "NET_SUSPICIOUS_SSH_001",
                "process = 'sshd.exe' AND src_ip NOT LIKE '127.%' AND dst_ip NOT LIKE '::%'",
            ),
            (
                "NET_WEBSERVER_INBOUND_001",
                f"{rx('process', fv.INBOUND_WEB_SERVER)} AND NOT contains(action, 'listen') AND NOT contains(action, 'bound') "
                "AND src_ip NOT LIKE '127.%'",
            ),
        ],
    ),
    "registry_row_rules": rule_rows(
        REG,
        "reg",
        [
            (
                "REG_RUNKEY_001",
                f"{rx('path', fv.RUN_KEY)} AND ({_INPATH} OR {_INWEB} OR {_HID})",
                f"CASE WHEN {_INWEB} OR {_HID} THEN 'critical' ELSE 'high' END",
                f"CASE WHEN {_INWEB} OR ({_HID} AND {_INPATH}) THEN 0.97 WHEN {_HID} THEN 0.93 ELSE 0.80 END",
            ),
            ("REG_DEFENDER_EXCLUSION_001", rx("path", fv.DEFENDER_EXCLUSION)),
            (
                "REG_SUSPICIOUS_SERVICE_001",
                f"contains(path, 'currentcontrolset\\services') AND {rx('data', fv.SERVICE_EXTENSION)} "
                f"AND {rx('data', fv.SERVICE_PATH)} AND NOT {rx('value', fv.LEGITIMATE_SERVICE)}",
            ),
        ],
    ),
    "task_row_rules": rule_rows(
        TASK,
        "task",
        [
            ("TASK_WEBROOT_EXEC_001", rx("command", fv.TASK_PATH)),
            ("TASK_PS_HIDDEN_001", rx("command", fv.TASK_HIDDEN_PS)),
            ("TASK_MASQUERADE_001", rx("task", fv.TASK_MASQUERADE)),
            ("TASK_LOLBIN_001", f"{_LOLBIN} IS NOT NULL AND NOT ({_LOLBIN} = 'rundll32' AND {_ORDINARY})"),
            # Of the interpreters only the script and the job file are paths outside the system.
            ("TASK_NON_SYSTEM_EXEC_001", "executable IN ('powershell.exe', 'cmd')"),
        ],
    ),
    "account_row_rules": rule_rows(
        SEC,
        "sec",
        [
            ("WIN_USER_CREATED_001", "kind = 3"),
            ("WIN_GROUP_ADD_001", "kind = 4 AND target IN ('administrators', 'remote desktop users')"),
            ("WIN_REMOTE_LOGIN_001", "kind <= 2 AND ltype IN ('3', '10') AND sid <> 's-1-5-18'"),
        ],
    ),
    "file_row_rules": rule_rows(
        FILES,
        "files",
        [
            (
                "SYS_SUSPICIOUS_FILE_DROP_001",
                f"code = 11 AND {rx('path', fv.DROP_EXTENSION)} AND {rx('path', fv.DROP_PATH)} "
                f"AND NOT {rx('path', fv.DROP_BENIGN_PATH)} AND NOT {rx('process', fv.DROP_BENIGN_PROCESS)}",
            ),
            ("WIN_SENSITIVE_FILE_DELETE_001", f"code = 26 AND ({_SENS} OR {rx('path', fv.SENSITIVE_PATH)})"),
            ("WIN_SYSTEM_FILE_DELETE_001", f"code = 26 AND {_SENS} AND {rx('path', fv.SYSTEM_DRIVE_PATH)}"),
        ],
    ),
    "wmi_row_rules": rule_rows(
        f"wmi AS (SELECT c_custkey AS ord, {pick('c_custkey % 3', ad.WMI_MESSAGES)} AS message FROM customer)",
        "wmi",
        [
            (
                "WMI_SUBSCRIPTION_001",
                f"NOT {rx('message', fv.WMI_LEGITIMATE)}",
                f"CASE WHEN {rx('message', fv.WMI_SUSPICIOUS)} THEN 'critical' ELSE 'high' END",
                f"CASE WHEN {rx('message', fv.WMI_SUSPICIOUS)} THEN 0.97 ELSE 0.85 END",
            )
        ],
    ),
    "html_rules": " UNION ALL ".join(
        f"SELECT {q(name)} AS rule_id, page_id FROM pages WHERE {rx('lower(html)', pattern)}"
        for name, pattern in (
            ("WEB_SQLI_001", fv.SQL_INJECTION),
            ("WEB_LFI_001", fv.PATH_TRAVERSAL),
            ("WEB_CMDI_001", fv.COMMAND_INJECTION),
            ("WEB_XSS_001", fv.SCRIPT_INJECTION),
        )
    ),
    "rule_contracts": f"""
        WITH {PROC}, p AS (SELECT *, '0x' || lower(to_hex(o_custkey)) AS logon,
            {_WATCHED} AND {_WEBPARENT} AND NOT {_INSTALLER} AS child,
            process IN ('net.exe', 'net1.exe') AND {_NEWUSER} IS NOT NULL AS adds,
            {_DIRECT} AND ({_NEWTASK} IS NOT NULL OR {_NEWRUN} IS NOT NULL) AS keeps,
            {_NEWUSER} AS new_user, {_NEWTASK} AS new_task, {_NEWRUN} AS new_run FROM proc)
        SELECT 'PROC_WEBSHELL_CHILD_001' AS rule_id, ord AS event_ord, 'requires' AS role, 'web_command' AS cap, command AS value
          FROM p WHERE child AND command IS NOT NULL UNION ALL
        SELECT 'PROC_WEBSHELL_CHILD_001', ord, 'provides', 'code_execution', command FROM p WHERE child AND command IS NOT NULL UNION ALL
        SELECT 'PROC_WEBSHELL_CHILD_001', ord, 'requires', 'session_established', logon FROM p WHERE child UNION ALL
        SELECT 'WIN_CMD_USER_CREATION_001', ord, 'provides', 'local_account_created', lower(new_user) FROM p WHERE adds UNION ALL
        SELECT 'WIN_CMD_USER_CREATION_001', ord, 'requires', 'session_established', logon FROM p WHERE adds UNION ALL
        SELECT 'WIN_CMD_PERSISTENCE_ARTIFACT_001', ord, 'provides', 'task_created', new_task FROM p WHERE keeps AND new_task IS NOT NULL UNION ALL
        SELECT 'WIN_CMD_PERSISTENCE_ARTIFACT_001', ord, 'provides', 'runkey_created', new_run FROM p WHERE keeps AND new_run IS NOT NULL UNION ALL
        SELECT 'WIN_CMD_PERSISTENCE_ARTIFACT_001', ord, 'requires', 'session_established', logon FROM p WHERE keeps""",
    "resolved_logons": f"""
        WITH {FILES} SELECT f.ord AS event_ord, coalesce(f.logon_id, '0x' || lower(to_hex(o.o_custkey + 1))) AS logon_id
        FROM files f LEFT JOIN orders o ON o.o_orderkey = f.l_orderkey
        WHERE f.code = 26 AND ({_SENS} OR {rx('path', fv.SENSITIVE_PATH)})""",
    # ------------------------------------------------------------ set rules
    "web_brute_force": f"""
        WITH {WEB} SELECT 'WEB_BRUTE_FORCE_001' AS rule_id, ip AS source_ip, path AS target_url, count(*) AS event_count,
          'medium' AS severity, CASE WHEN contains(path, 'login') THEN 0.95 ELSE 0.80 END::DOUBLE AS confidence,
          epoch_us(arg_min(ts, event_id)) AS first_us,
          count(*) || ' repeated requests to ''' || path || ''' from ' || ip AS description
        FROM web WHERE status IN (401, 403) OR (method = 'post' AND status = 302) GROUP BY ip, path HAVING count(*) >= 10""",
    "web_recon_scan": f"""
        WITH {WEB}, h AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY event_id) AS r FROM web WHERE status = 404)
        SELECT 'WEB_RECON_SCAN_001' AS rule_id, ip AS source_ip,
          '["' || string_agg(path, '","' ORDER BY event_id) FILTER (WHERE r <= 5) || '"]' AS sample_urls,
          count(*) AS event_count, 'medium' AS severity, 0.85::DOUBLE AS confidence, epoch_us(arg_min(ts, event_id)) AS first_us,
          count(*) || ' 404 requests from ' || ip || ' — possible directory scan' AS description
        FROM h GROUP BY ip HAVING count(*) >= 20""",
    "web_scanners": f"""
        WITH {WEB}, a AS (SELECT *, lower({grp("lower(agent)", fv.SCANNER_AGENT)}) AS tool FROM web)
        SELECT 'WEB_SCANNER_UA_001' AS rule_id, tool, ip AS source_ip, count(*) AS event_count, 'medium' AS severity,
          0.95::DOUBLE AS confidence, epoch_us(arg_min(ts, event_id)) AS first_us,
          'Scanning tool ''' || tool || ''' detected — ' || count(*) || ' requests from ' || ip AS description
        FROM a WHERE tool IS NOT NULL GROUP BY tool, ip""",
    "login_outcomes": f"""
        WITH {WEB}, n AS (SELECT *, lead(path) OVER (PARTITION BY ip ORDER BY ts, event_id) AS next_path FROM web)
        SELECT event_id AS ord, ip AS src_ip, coalesce(NOT contains(next_path, '/login.php'), false) AS succeeded
        FROM n WHERE contains(path, '/login.php') AND method = 'post' AND status = 302""",
    "web_login_after_failures": f"""
        WITH {WEB}, n AS (SELECT *, lead(path) OVER (PARTITION BY ip ORDER BY ts, event_id) AS next_path FROM web),
        a AS (SELECT *, coalesce(NOT contains(next_path, '/login.php'), false) AS ok FROM n
          WHERE contains(path, '/login.php') AND method = 'post' AND status = 302),
        f AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
          PARTITION BY ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM a),
        s AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, event_id) AS r FROM f WHERE ok AND prior >= 3)
        SELECT 'WEB_LOGIN_SUCCESS_AFTER_BF_001' AS rule_id, ip AS source_ip, CAST(prior AS VARCHAR) AS failed_count,
          CAST(least(prior, 10) + 1 AS BIGINT) AS event_count, 'high' AS severity, 0.92::DOUBLE AS confidence, epoch_us(ts) AS first_us,
          'Login success on /login.php from ' || ip || ' after ' || CAST(prior AS BIGINT) || ' failed attempts' AS description
        FROM s WHERE r = 1""",
    "logon_brute_force": f"""
        WITH {SEC} SELECT target AS target_user, count(*) AS event_count, 0.9::DOUBLE AS confidence,
          count(*) || ' failed login attempts for ''' || target || '''' AS description
        FROM sec WHERE kind IN (1, 2) GROUP BY target HAVING count(*) >= 5""",
    "mass_deletion": f"""
        WITH {FILES} SELECT coalesce(logon_id, guid) AS actor_key, CAST(count(*) AS VARCHAR) AS file_count,
          CAST(max(sec) - min(sec) AS VARCHAR) AS window_seconds, min(sec) * 1000000 AS first_us
        FROM files WHERE code = 26 GROUP BY 1 HAVING count(*) >= 3 AND max(sec) - min(sec) <= 300""",
    "arp_poisoning": """
        SELECT 'aa:00:00:00:' || s_nationkey || ':' || (s_suppkey % 2) AS mac, count(*) AS event_count,
          'MAC ''' || 'aa:00:00:00:' || s_nationkey || ':' || (s_suppkey % 2) || ''' associated with ' || count(*) || ' IPs' AS description
        FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY s_nationkey, s_suppkey % 2 HAVING count(*) >= 2""",
    "script_blocks": f"""
        WITH s AS (SELECT conv_id, turn,
            CASE WHEN turn = 0 THEN 4104 WHEN turn % 3 = 1 THEN 4105 WHEN turn % 3 = 2 AND conv_id % 3 <> 0 THEN 4106 ELSE 4104 END AS code,
            lower(text || {pick("conv_id % 4", ["", " iex (x)", " -enc aa", " $env:temp\\a.exe"])}) AS script FROM conversations),
        b AS (SELECT 'block-' || conv_id AS block_id, bool_or(code = 4105) AS started, bool_or(code = 4106) AS completed,
            bool_or(code = 4104 AND {rx("script", fv.SUSPICIOUS_SCRIPT)}) AS logged FROM s GROUP BY 1)
        SELECT 'PS_ORPHANED_SCRIPTBLOCK_001' AS rule_id, block_id, 1::BIGINT AS event_count, 'medium' AS severity FROM b
          WHERE started AND NOT completed UNION ALL
        SELECT 'PS_CONFIRMED_SUSPICIOUS_EXEC_001', block_id, 2, 'critical' FROM b WHERE started AND logged""",
    "finding_triggers": f"""
        WITH {WEB}, h AS (SELECT *, count(*) OVER (PARTITION BY ip, path) AS n FROM web
          WHERE status IN (401, 403) OR (method = 'post' AND status = 302))
        SELECT ip AS source_ip, path AS url, event_id AS event_ord FROM h WHERE n >= 10""",
    # ------------------------------------------------------------ joins and links
    "nearest_view": """
        WITH v AS (SELECT * FROM events WHERE event_type = 'view'),
        p AS (SELECT e.event_id, v.event_id AS view_id, abs(epoch_us(e.ts) - epoch_us(v.ts)) AS gap_us,
            row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(v.ts)), v.event_id) AS r
          FROM events e JOIN v ON v.user_id = e.user_id AND abs(epoch_us(e.ts) - epoch_us(v.ts)) <= 600000000
          WHERE e.event_type = 'error')
        SELECT e.event_id, p.view_id, p.gap_us FROM events e LEFT JOIN p ON p.event_id = e.event_id AND p.r = 1
        WHERE e.event_type = 'error'""",
    "contract_ranges": """
        SELECT lpad(CAST(c.event_id AS VARCHAR), 12, '0') AS target, count(*) AS n_sources,
          epoch_us(min(p.ts)) AS first_us, epoch_us(max(p.ts)) AS last_us
        FROM events c JOIN events p ON p.user_id = c.user_id AND p.event_type = 'signup'
          AND abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 21600000000
        WHERE c.event_type = 'purchase' GROUP BY c.event_id""",
    "lineage_ranges": """
        WITH t AS (SELECT o_orderkey AS k, epoch(o_orderdate) + o_orderkey % 86400 AS sec FROM orders)
        SELECT 'guid:{g-' || p.k || '}' AS process_key, lpad(CAST(c.k AS VARCHAR), 12, '0') AS target, 1::BIGINT AS n_sources
        FROM t c JOIN t p ON p.k = c.k // 2 AND p.k <> c.k AND abs(p.sec - c.sec) <= 21600""",
    # ------------------------------------------------------------ fusion
    "fused_components": """
        WITH RECURSIVE k AS (
          SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 't' || md5(text) AS key FROM documents UNION ALL
          SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0'), 's' || source || '|' || n_chars FROM documents),
        e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id),
        r(id, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
        SELECT id, min(reach) AS cluster FROM r GROUP BY id""",
    "fused_findings": f"""
        WITH RECURSIVE k AS (
          SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 't' || md5(text) AS key FROM documents UNION ALL
          SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0'), 's' || source || '|' || n_chars FROM documents),
        e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id),
        r(id, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
        l AS (SELECT id, min(reach) AS cluster FROM r GROUP BY id),
        d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, doc_id, doc_id % 5 AS sev, (doc_id % 7) / 10 AS conf, lang,
            '0x' || upper(to_hex(n_chars)) AS logon FROM documents),
        m AS (SELECT d.*, coalesce(l.cluster, d.id) AS cluster FROM d LEFT JOIN l ON l.id = d.id)
        SELECT first(id ORDER BY sev DESC, conf DESC, doc_id) AS id, count(*) AS members, ({SEV})[CAST(max(sev) AS INT) + 1] AS severity,
          CAST(max(conf) AS DOUBLE) AS confidence, count(*)::BIGINT AS event_count,
          string_agg(DISTINCT lang, ',' ORDER BY lang) AS tags, count(DISTINCT logon) > 1 AS logon_id_conflict,
          CASE WHEN count(DISTINCT logon) = 1 THEN min(logon) END AS logon_id
        FROM m GROUP BY cluster""",
    "identity_groups": f"""
        WITH {WEB}, n AS (SELECT event_id AS id, event_type = 'error' AS entry, CASE WHEN k % 9 = 0 THEN ip END AS ip,
            CASE WHEN k % 3 = 0 THEN 'guid:g' || user_id || '-' || k ELSE 'pid:' || (user_id * 100 + k) END AS process,
            CASE WHEN k % 4 = 0 THEN CASE WHEN user_id % 10 = 0 THEN NULL ELSE 's-1-5-' || (user_id + 100) END
              WHEN k % 4 = 1 AND user_id + 100 NOT IN (18, 19, 20) THEN 's-1-5-' || (user_id + 100) END AS sid,
            CASE WHEN k % 5 = 0 THEN '0x' || lower(to_hex(user_id * 128 + k)) END AS logon FROM web),
        g AS (SELECT 'network' AS kind, ip AS key, ip FROM n WHERE ip IS NOT NULL UNION ALL
          SELECT 'account', sid, ip FROM n WHERE sid IS NOT NULL UNION ALL
          SELECT 'process', process, ip FROM n WHERE NOT entry UNION ALL
          SELECT 'logon', logon, ip FROM n WHERE NOT entry AND logon IS NOT NULL AND logon NOT IN ('0x3e7', '0x3e4', '0x3e5')
            AND logon NOT IN (SELECT logon FROM n WHERE entry AND logon IS NOT NULL))
        SELECT kind, key, count(*) AS n FROM g GROUP BY 1, 2
        HAVING count(*) > 1 AND (kind = 'network' OR count(DISTINCT ip) < 2)""",
    # ------------------------------------------------------------ graph measures
    "longest_path_rank": """
        SELECT 'r' || r_regionkey AS id, 0 AS rank FROM region UNION ALL
        SELECT 'n' || n_nationkey, 1 + n_nationkey // 5 FROM nation UNION ALL
        SELECT 'c' || c_custkey, 2 + c_nationkey // 5 FROM customer""",
    "lane_counts": """
        WITH n AS (SELECT 'reconnaissance' AS phase, 0 AS lane, 0 AS rank FROM region UNION ALL
          SELECT 'delivery', 2, 1 + n_nationkey // 5 FROM nation UNION ALL
          SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'installation' ELSE 'exploitation' END,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE 3 END, 2 + c_nationkey // 5 FROM customer)
        SELECT phase, rank, count(*) AS nodes, max(count(*)) OVER (PARTITION BY phase) AS widest, lane::BIGINT AS lane
        FROM n GROUP BY phase, lane, rank""",
    "induced_subgraph": """
        SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL
        SELECT 'n' || (n_nationkey - 5), 'n' || n_nationkey FROM nation WHERE n_nationkey >= 5 UNION ALL
        SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "closed_neighbourhood": """
        SELECT 'n7' AS id UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION
        SELECT 'n2' UNION SELECT 'n12' UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 7""",
    # ------------------------------------------------------------ reports
    "finding_summary": f"""
        SELECT 'host' || (o_custkey % 100) AS host, count(*) AS findings, ({SEV})[CAST(max(o_orderkey % 4) AS INT) + 1] AS max_severity
        FROM orders GROUP BY 1""",
    "sticky_severity": f"""
        WITH n AS (SELECT o_custkey AS custkey, max(o_orderkey % 4) AS now FROM orders GROUP BY 1),
        s AS (SELECT c_custkey AS custkey, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS kept FROM customer)
        SELECT custkey, ({SEV})[CAST(greatest(1, kept, now) AS INT) + 1] AS max_severity FROM s FULL JOIN n USING (custkey)""",
    "host_rollup": f"""
        SELECT 'host' || (o_custkey % 100) AS host, CAST(last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS latest_scan,
          ({SEV})[CAST(max(o_orderkey % 4) AS INT) + 1] AS max_severity, max(o_custkey % 37) AS max_findings,
          max(CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 11 END) AS max_actors, count(*) AS total_scans
        FROM orders WHERE contains('host' || (o_custkey % 100), 'host1') GROUP BY 1""",
    "finding_facets": f"""
        SELECT 'severity' AS facet, ({SEV})[CAST(o_orderkey % 4 AS INT) + 1] AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
        SELECT 'kill_chain_phase', ({arr(fv.KILL_CHAIN_PHASES)})[CAST(o_orderkey % 7 AS INT) + 1], count(*) FROM orders GROUP BY 2""",
    "finding_search": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS id, ({SEV})[CAST(o_orderkey % 4 AS INT) + 1] AS severity FROM orders
        WHERE o_orderkey % 4 IN (2, 3) AND contains(lower(o_orderpriority), 'urgent')""",
    "actor_summary": f"""
        WITH f AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderdate AS t, o_orderkey % 4 AS s,
            ({arr(fv.KILL_CHAIN_PHASES)})[CAST(o_orderkey % 7 AS INT) + 1] AS p,
            CASE WHEN o_orderkey % 3 = 0 THEN '10.0.0.' || (o_orderkey % 90) END AS ip FROM orders),
        g AS (SELECT a, count(*) AS nodes, first(ip ORDER BY s DESC, k) FILTER (WHERE ip IS NOT NULL) AS ip, max(s) AS s,
            first(p ORDER BY t, k) AS p1, last(p ORDER BY t, k) AS p2 FROM f GROUP BY a)
        SELECT CAST(a AS INT) AS actor, nodes, coalesce(ip, 'ID: ' || a) AS label, ({SEV})[CAST(s AS INT) + 1] AS max_severity,
          CASE WHEN p1 = p2 THEN p1 ELSE p1 || ' → ' || p2 END AS phases FROM g""",
    "alert_listing": f"""
        WITH {WEB} SELECT 'WEB_BRUTE_FORCE_001' AS rule_id, 'medium' AS severity,
          count(*) || ' repeated requests to ''' || path || ''' from ' || ip AS description, 'bruteforce,web,auth' AS tags, count(*) AS event_count
        FROM web WHERE status IN (401, 403) OR (method = 'post' AND status = 302) GROUP BY ip, path HAVING count(*) >= 10 UNION ALL
        SELECT 'WEB_RECON_SCAN_001', 'medium', count(*) || ' 404 requests from ' || ip || ' — possible directory scan',
          'recon,scanning,web', count(*) FROM web WHERE status = 404 GROUP BY ip HAVING count(*) >= 20""",
    "flattened_events": f"""
        WITH {WEB} SELECT 'timestamp' AS name, count(*) AS n, count(DISTINCT ts) AS "values" FROM web UNION ALL
        SELECT 'event.action', count(*), 1 FROM web UNION ALL SELECT 'event.dataset', count(*), 1 FROM web UNION ALL
        SELECT 'event.created', count(*), count(DISTINCT ts) FROM web UNION ALL
        SELECT 'source.ip', count(*), count(DISTINCT ip) FROM web UNION ALL
        SELECT 'http.request_method', count(*), count(DISTINCT method) FROM web UNION ALL
        SELECT 'http.response_status_code', count(*), count(DISTINCT status) FROM web UNION ALL
        SELECT 'http.user_agent', count(*), count(DISTINCT lower(agent)) FROM web UNION ALL
        SELECT 'url.path', count(*), count(DISTINCT path) FROM web""",
}
ORACLES["normalized_processes"] = ORACLES["normalized_processes"].replace("args_count0", "args_count").replace(
    "nullif(len(list_filter(string_split(trim(raw_command), ' '), lambda w: w <> '')) - 1, 0)",
    "CASE WHEN len(list_filter(string_split(trim(raw_command), ' '), lambda w: w <> '')) > 1 "
    "THEN len(list_filter(string_split(trim(raw_command), ' '), lambda w: w <> '')) - 1 END",
)
