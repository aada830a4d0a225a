"""Security telemetry derived from the general test tables.

The tables hold no host telemetry, so fixed formulas give their rows the shape of raw records
or of normalised events.  Every adapter reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.events import build_events
from casegraph.session import tune_runtime

c = F.col
lit = F.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune_runtime(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all task slots, two parts each.

    A small table is one row group, which one task reads; only its columns that are used are dealt.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def pick(index: Column, values: list[str]) -> Column:
    """``values[index]``; the index is evaluated once."""
    return F.get(F.array(*[lit(v) for v in values]), index.cast("int"))


# ------------------------------------------------------------------ events as web requests
URL_PAYLOADS = [
    "/item?id=1 union select password from users",
    "/view?page=../../etc/passwd",
    "/run?q=;whoami",
    "/search?q=<script>alert(1)</script>",
    "/uploads/shell.php?cmd=whoami",
    "/uploads/tool.exe",
    "/files/backdoor.jsp",
    "/index?file=report.txt",
    "/static/site.css",
    "/api/v1/items?run=hostname&page=a/b.html",
]
BODY_PAYLOADS = [
    "name=bob&note=hello",
    "q=;whoami",
    "a=ok&b=%7C+net+user+x+y",
    "x=1&cmd=powershell+-w+hidden",
    "data=ipconfig%26",
]
AGENTS = [
    "Mozilla/5.0",
    "sqlmap/1.7",
    "Mozilla/5.0 (compatible)",
    "curl/8.0",
    "Nikto/2.5",
    "Mozilla/4.0",
    "python-requests/2.31",
]


def web_columns(events: DataFrame) -> DataFrame:
    """The web request each event stands for."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = c("user_id")
    signup, purchase = c("event_type") == "signup", c("event_type") == "purchase"
    return events.select(
        c("event_id"),
        c("ts"),
        c("user_id"),
        c("event_type"),
        k.alias("k"),
        F.concat_ws(
            ".",
            lit("10"),
            F.floor(user / 65536).cast("string"),
            (F.floor(user / 256) % 256).cast("string"),
            (user % 256).cast("string"),
        ).alias("ip"),
        F.when(c("event_type") == "error", 404)
        .when(signup & (k % 2 == 0), 401)
        .when(signup | purchase, 302)
        .otherwise(200)
        .alias("status"),
        F.when(signup | purchase, lit("post")).otherwise(lit("get")).alias("method"),
        F.when(signup, lit("/login.php"))
        .otherwise(F.concat(lit("/p/"), (k % 5).cast("string")))
        .alias("path"),
        pick(k % 10, URL_PAYLOADS).alias("attack_url"),
        pick(k % 5, BODY_PAYLOADS).alias("body"),
        pick(user % 7, AGENTS).alias("agent"),
    )


def web_events(spark: SparkSession, sf_dir: str, attack: bool = False) -> DataFrame:
    """Normalised web events; with ``attack`` the path is one of the attack payloads."""
    rows = web_columns(table(spark, sf_dir, "events")).select(
        lit("web").alias("collection_id"), c("event_id").alias("ord"), "*"
    )
    path = c("attack_url") if attack else c("path")
    parser = {
        "timestamp": c("ts"),
        "event.action": lit("apache_access_log"),
        "event.dataset": lit("apache.access"),
        "event.created": c("ts"),
        "source.ip": c("ip"),
        "http.request_method": c("method"),
        "http.response_status_code": c("status"),
        "http.user_agent": F.lower("agent"),
        "url.path": F.lower(path),
    }
    if attack:
        parser["http.request_body"] = F.when(c("method") == "post", c("body"))
    built = build_events(rows, "web_logs", [(None, parser)], c("event_id").cast("string"))
    return built.withColumn("id", c("ord").cast("string"))


# ------------------------------------------------------------------ raw Windows records
COMMANDS = [
    "net user Backdoor P@ss /add",
    'cmd.exe /c "whoami /all"',
    "powershell -enc AAAA run",
    "schtasks /create /tn Updater /tr C:\\temp\\a.exe",
    "reg add HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run /v Evil /d x",
    "C:\\xampp\\php\\php.exe -v",
    "notepad.exe C:\\a.txt",
    "php.exe -r phpinfo();",
    "powershell -windowstyle hidden -file a.ps1",
    "",
    "IEX (DownloadString)",
]
IMAGES = [
    "C:\\Windows\\System32\\cmd.exe",
    "C:\\Windows\\System32\\PowerShell.exe",
    "C:\\Windows\\System32\\net.exe",
    "C:\\Windows\\System32\\schtasks.exe",
    "C:\\tools\\reg.exe",
    "C:\\Windows\\Explorer.exe",
    "C:\\xampp\\perl\\bin\\perl.exe",
]
PARENTS = [
    "C:\\xampp\\apache\\bin\\httpd.exe",
    "C:\\Windows\\explorer.exe",
    "C:\\Windows\\System32\\sshd.exe",
    "C:\\nginx\\nginx.exe",
    "C:\\Windows\\services.exe",
]
FILES = [
    "C:\\Windows\\Temp\\drop.exe",
    "C:\\Users\\Public\\run.ps1",
    "C:\\inetpub\\wwwroot\\index.html",
    "C:\\Program Files\\app\\core.dll",
    "C:\\data\\sales.sqlite",
    "D:\\music\\song.mp3",
    "C:\\Windows\\WinSxS\\Temp\\x.dll",
    "C:\\xampp\\htdocs\\shell.php",
    "C:\\ProgramData\\settings.ini",
]


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def data_map(**entries: Column) -> Column:
    items: list[Column] = []
    for key, value in entries.items():
        items += [lit(key), value.cast("string")]
    return F.create_map(*items)


def sysmon_process_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process-create records, one per order."""
    key = c("o_orderkey")
    image, parent = pick(key % 7, IMAGES), pick(c("o_custkey") % 5, PARENTS)
    return table(spark, sf_dir, "orders").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        iso(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + key % 86400)).alias("time_created"),
        lit(1).alias("event_id"),
        lit("process created").alias("message"),
        data_map(
            Image=image,
            CommandLine=pick(key % 11, COMMANDS),
            User=F.concat(lit("CORP\\User"), c("o_custkey")),
            ProcessId=key % 5000,
            ProcessGuid=F.concat(lit("{G-"), key, lit("}")),
            ParentProcessId=c("o_custkey") % 5000,
            ParentImage=parent,
            ParentCommandLine=F.concat(parent, lit(" -k")),
            ParentProcessGuid=F.concat(lit("{G-"), F.floor(key / 2).cast("bigint"), lit("}")),
            LogonId=F.concat(lit("0x"), F.hex(c("o_custkey"))),
            Hashes=F.concat(lit("SHA256="), key),
        ).alias("event_data"),
    )


def sysmon_file_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-create and file-delete records, one per order line.

    A day of ship date counts as a second, so lines of an order can fall into minutes.
    """
    seconds = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date"))
    key = c("l_orderkey") * 10 + c("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        iso(F.timestamp_seconds(seconds)).alias("time_created"),
        F.when(c("l_partkey") % 4 == 0, 11).otherwise(26).alias("event_id"),
        lit("file event").alias("message"),
        data_map(
            Image=pick(c("l_partkey") % 7, IMAGES),
            ProcessGuid=F.concat(lit("{P-"), c("l_orderkey"), lit("}")),
            ProcessId=c("l_suppkey"),
            User=lit("CORP\\svc"),
            TargetFilename=pick((c("l_partkey") + c("l_suppkey")) % 9, FILES),
            LogonId=F.when(
                c("l_orderkey") % 3 != 0, F.concat(lit("0x"), F.lower(F.hex(c("l_orderkey") + 4096)))
            ),
        ).alias("event_data"),
    )


def security_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon, failed-logon, account and group records, one per order."""
    key, user = c("o_orderkey"), c("o_custkey")
    kind = key % 5
    sid = F.when(user % 50 == 0, lit("S-1-5-18")).otherwise(F.concat(lit("S-1-5-21-"), user))
    return table(spark, sf_dir, "orders").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        iso(c("o_orderdate")).alias("time_created"),
        F.when(kind == 0, 4624).when(kind <= 2, 4625).when(kind == 3, 4720).otherwise(4732).alias("event_id"),
        lit("security").alias("message"),
        data_map(
            TargetUserName=F.when(
                kind == 4, pick(user % 3, ["Administrators", "Users", "Remote Desktop Users"])
            ).otherwise(F.concat(lit("User"), user % 400)),
            TargetDomainName=lit("CORP\\"),
            TargetUserSid=sid,
            TargetSid=sid,
            MemberSid=F.when(user % 7 != 0, sid),
            IpAddress=F.concat(lit("10.1.0."), user % 200),
            IpPort=user % 60000,
            ProcessId=F.concat(lit("0x"), F.hex(user % 4096)),
            ProcessName=lit("C:\\Windows\\System32\\lsass.exe"),
            TargetLogonId=F.concat(lit("0x00"), F.hex(key + 16)),
            LogonType=pick(user % 4, ["2", "3", "10", "x"]),
        ).alias("event_data"),
    )


def script_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script-block records from conversation turns."""
    turn = c("turn")
    return table(spark, sf_dir, "conversations").select(
        lit("host").alias("collection_id"),
        (c("conv_id") * 1000 + turn).alias("ord"),
        lit("2024-01-01T00:00:00Z").alias("time_created"),
        F.when(turn == 0, 4104)
        .when(turn % 3 == 1, 4105)
        .when((turn % 3 == 2) & (c("conv_id") % 3 != 0), 4106)
        .otherwise(4104)
        .alias("event_id"),
        c("text").alias("message"),
        data_map(
            ScriptBlockId=F.concat(lit("BLOCK-"), c("conv_id")),
            ScriptBlockText=F.concat(
                c("text"), pick(c("conv_id") % 4, ["", " iex (x)", " -enc aa", " $env:temp\\a.exe"])
            ),
            RunspaceId=F.concat(lit("R"), turn),
        ).alias("event_data"),
    )


WMI_MESSAGES = [
    "Namespace = //./root/subscription; Eventfilter = f; Consumer = CommandLineEventConsumer=\"Evil\"; "
    "PossibleCause = Binding { CreatorSID = {1, 5, 0, 0, 0, 0, 0, 5, 21, 0, 0, 0, 1, 2, 0, 0, 7, 0, 0, 0, 8, 0, 0, 0, 244, 1, 0, 0} }; cmd.exe /c x",
    "Namespace = //./root; Consumer = NTEventLogEventConsumer=\"SCM Event Log Consumer\"; PossibleCause = Permanent",
    "Namespace = //./root; Consumer = ActiveScriptEventConsumer=\"Plain\"; PossibleCause = none",
]


def wmi_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription records, one per customer."""
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        lit("host").alias("collection_id"),
        c("c_custkey").alias("ord"),
        lit("2024-01-01T00:00:00Z").alias("time_created"),
        lit(5861).alias("event_id"),
        pick(c("c_custkey") % 3, WMI_MESSAGES).alias("message"),
    )


# ------------------------------------------------------------------ raw snapshots
SOCKET_PROCESSES = ["cmd.exe", "httpd.exe", "sshd.exe", "chrome.exe", "PowerShell.exe", "nginx", "nc"]
SOCKET_STATES = ["Listen", "Established", "Bound", "TimeWait"]
SOCKET_PORTS = ["4444", "80", "8080", "22", "60000", "31337", "443", "5555", "1337"]


def network_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP connections, one per customer, and one ARP entry per supplier."""
    key = c("c_custkey")
    none = lit(None).cast("string")
    tcp = table(spark, sf_dir, "customer").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        lit("tcp_connections").alias("kind"),
        F.when(key % 13 == 0, lit("127.0.0.1")).otherwise(F.concat(lit("10.2.0."), key % 250)).alias("local_address"),
        pick(key % 9, SOCKET_PORTS).alias("local_port"),
        F.when(key % 11 == 0, lit("::1")).otherwise(F.concat(lit("172.16.0."), key % 199)).alias("remote_address"),
        pick((key + c("c_nationkey")) % 9, SOCKET_PORTS).alias("remote_port"),
        pick(c("c_nationkey") % 4, SOCKET_STATES).alias("state"),
        (key % 3000).cast("string").alias("pid"),
        pick(key % 7, SOCKET_PROCESSES).alias("process_name"),
        none.alias("ip_address"),
        none.alias("mac_address"),
        none.alias("interface"),
        none.alias("gateway"),
        none.alias("dns_servers"),
        none.alias("data"),
        none.alias("entry"),
    )
    supplier = c("s_suppkey")
    arp = table(spark, sf_dir, "supplier").select(
        lit("host").alias("collection_id"),
        (supplier + 1_000_000_000).alias("ord"),
        lit("arp_cache").alias("kind"),
        *[none.alias(n) for n in ("local_address", "local_port", "remote_address", "remote_port", "state", "pid", "process_name")],
        F.concat(lit("192.168.0."), supplier).alias("ip_address"),
        F.when(supplier % 10 == 0, lit("FF:FF:FF:FF:FF:FF"))
        .otherwise(F.concat(lit("AA:00:00:00:"), c("s_nationkey"), lit(":"), supplier % 2))
        .alias("mac_address"),
        *[none.alias(n) for n in ("interface", "gateway", "dns_servers", "data", "entry")],
    )
    return tcp.unionByName(arp)


REGISTRY_KEYS = [
    "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce",
    "HKLM\\Software\\Microsoft\\Windows Defender\\Exclusions\\Paths",
    "HKLM\\SYSTEM\\CurrentControlSet\\Services\\app",
    "HKLM\\Software\\Vendor",
]
REGISTRY_DATA = [
    "C:\\Users\\Public\\a.exe",
    "C:\\inetpub\\wwwroot\\b.exe",
    "powershell -w hidden -enc x",
    "C:\\Temp\\powershell.exe -w hidden",
    "C:\\Program Files\\ok.exe",
    "\"C:\\Temp\\svc.exe\" -k run",
    "rundll32 C:\\Windows\\x.dll,Start",
]
SERVICE_NAMES = ["audiosrv", "evilsvc", "wlansvc", "helper"]


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry values, one per part."""
    key = c("p_partkey")
    data = pick(key % 7, REGISTRY_DATA)
    return table(spark, sf_dir, "part").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        pick(key % 5, REGISTRY_KEYS).alias("key_path"),
        pick(key % 4, SERVICE_NAMES).alias("name"),
        data.alias("value"),
        data.alias("imagepath"),
    )


TASK_NAMES = ["\\Updater", "Backup", "'svchost'", "Windows Update", "Cleaner"]
TASK_ACTIONS = [
    "C:\\xampp\\htdocs\\run.bat",
    "powershell.exe -NoProfile -File C:\\scripts\\a.ps1",
    "rundll32.exe shell32.dll,Control",
    "rundll32.exe C:\\Windows\\System32\\x.dll",
    "rundll32.exe sysmain.dll,Run",
    "\"C:\\Program Files\\App\\app.exe\" --quiet",
    "certutil.exe -decode a b",
    "cmd /c D:/tools/job.cmd",
    "C:\\Program Files\\Vendor\\tool.exe -x -y",
]


def task_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled tasks, one per part."""
    key = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        lit("host").alias("collection_id"),
        key.alias("ord"),
        pick(key % 5, TASK_NAMES).alias("task_name"),
        lit("Ready").alias("state"),
        F.array(pick(key % 9, TASK_ACTIONS)).alias("actions"),
        F.concat(lit("/Date("), F.lit(1600000000000) + key * 1000, lit(")/")).alias("last_run"),
        lit("0").alias("last_result"),
    )


# ------------------------------------------------------------------ log text and traffic
def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log text, one line per event; some lines are broken."""
    rows = web_columns(table(spark, sf_dir, "events"))
    line = F.concat(
        c("ip"),
        lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        lit(" +0000] \""),
        F.upper("method"),
        lit(" "),
        c("path"),
        lit(" HTTP/1.1\" "),
        c("status"),
        lit(" "),
        F.when(c("k") % 3 == 0, lit("-")).otherwise(c("k").cast("string")),
        lit(" \"-\" \""),
        c("agent"),
        F.when(c("k") % 17 == 0, lit("")).otherwise(lit("\"")),
    )
    return rows.select(c("event_id").alias("ord"), line.alias("line"))


def traffic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumped traffic from conversations: the first turn opens a request, later ones are body.

    The content-length is the number of bytes of all turns but the last.
    """
    text = F.regexp_replace("text", r"[\\\r\n\t\"]", " ")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"))
    total = turns.groupBy("conv_id").agg(
        F.sum(F.octet_length("t")).alias("bytes"), F.max("turn").alias("last")
    )
    rows = turns.join(total, "conv_id")
    head = F.concat(
        lit("POST /c/"), c("conv_id"), lit(" HTTP/1.1\\r\\nContent-Length: "), c("bytes"), lit("\\r\\n\\r\\n")
    )
    payload = F.when(c("turn") == 0, F.concat(head, c("t"))).otherwise(c("t"))
    return rows.select(
        lit("host").alias("collection_id"),
        (c("conv_id") * 1000 + c("turn")).alias("ord"),
        lit("Mon Jan 01 00:00:00.000001 2024").alias("timestamp"),
        lit("dumpio:trace7").alias("level"),
        F.concat(lit("10.9.0.1:"), c("conv_id") % 13).alias("client"),
        F.concat(lit("mod_dumpio:  dumpio_in (data-HEAP): "), payload).alias("message"),
    )
