"""Fixed values.

Everything in this module is a constant that detection results depend on: regular
expressions, word lists, thresholds, time windows and the rule catalogue.  The values are
stated plainly; the logic that uses them lives in ``functions`` and ``plans``.

Patterns are written in the common subset of Java and RE2 syntax and are matched without
regard to case unless their name ends in ``_CS``.
"""

# ---------------------------------------------------------------- orders (fixed values)
SEVERITIES = ("info", "low", "medium", "high", "critical")

KILL_CHAIN_PHASES = (
    "reconnaissance",
    "weaponization",
    "delivery",
    "exploitation",
    "installation",
    "command_and_control",
    "actions_on_objectives",
)

CHANNELS = (
    "wmi",
    "security",
    "sysmon",
    "application",
    "system",
    "powershell",
    "processes",
    "network",
    "registry",
    "scheduled_tasks",
    "web_logs",
)

# ------------------------------------------------- identity and graph (fixed values)
GENERIC_SIDS = ("S-1-5-18", "S-1-5-19", "S-1-5-20")
GENERIC_LOGON_IDS = ("0x3e7", "0x3e4", "0x3e5")
ENTRY_POINT_RULES = ("NET_WEBSERVER_INBOUND_001",)
IDENTITY_KEYS = ("logon_id", "user_sid", "member_sid")
LINK_WINDOW_SECONDS = 6 * 3600
TIGHT_LINK_WINDOW_SECONDS = 120
TIGHT_CONTRACTS = ("code_execution",)
FUZZY_BIND_FIELDS = ("command_line", "command", "body", "query", "args", "script_text")
FUZZY_THRESHOLD = 0.9

# ---------------------------------------------------------- thresholds (fixed values)
LOGON_FAILURE_THRESHOLD = 5
ARP_ENTRY_THRESHOLD = 2
MASS_DELETE_THRESHOLD = 3
MASS_DELETE_WINDOW_SECONDS = 300
MASS_DELETE_SAMPLE = 20
WEB_FAILURE_THRESHOLD = 10
RECON_THRESHOLD = 20
RECON_SAMPLE = 5
LOGIN_FAILURES_BEFORE_SUCCESS = 3
LOGIN_FAILURE_TRIGGERS = 10
LOGIN_PATH = "/login.php"
AUTH_URL_WORDS = ("login", "signin", "auth", "password", "brute")

# ---------------------------------------------------------- accounts (fixed values)
PRIVILEGED_GROUPS = (
    "administrators",
    "domain admins",
    "enterprise admins",
    "backup operators",
    "remote desktop users",
)
REMOTE_LOGON_TYPES = (3, 8, 10)

# ---------------------------------------------------------- network (fixed values)
LISTENER_PROCESS = (
    r"^(cmd|powershell|wscript|cscript|mshta|regsvr32"
    r"|rundll32|certutil|bitsadmin|wmic|msiexec|nc|ncat|netcat)"
    r"(\.exe)?$"
)
SUSPICIOUS_PORTS = (
    4444, 4445, 4446, 1234, 5555, 5554,
    8888, 9001, 9999, 6666, 2222, 31337,
    1337, 8080, 8443, 8000,
)
EPHEMERAL_PORT_START = 49152
INBOUND_WEB_SERVER = r"^(httpd|apache|apache2|nginx|w3wp|php-cgi)(\.exe)?$"
BROADCAST_MAC = "ff:ff:ff:ff:ff:ff"

# ---------------------------------------------------------- processes (fixed values)
WATCHED_PROCESS = (
    r"^(cmd|powershell|wscript|cscript|mshta|regsvr32"
    r"|rundll32|certutil|bitsadmin|wmic|msiexec|nc|ncat"
    r"|netcat|whoami|net|net1|schtasks|reg)(\.exe)?$"
)
SUSPICIOUS_COMMAND = (
    r"(net\s+user\s+\w+|net\s+localgroup\s+administrators"
    r"|schtasks\s+/create|reg\s+add.*\\run"
    r"|add-mppreference\s+-exclusion"
    r"|invoke-webrequest|iex\s*\(|downloadstring"
    r"|encodedcommand|-enc\s|frombase64string"
    r"|-windowstyle\s+hidden|-w\s+hidden)"
)
WEB_SERVER_PARENT = r"^(httpd|apache|php-cgi|w3wp|nginx|tomcat)(\.exe)?$"
BENIGN_PHP_PROBE = (
    r"echo\s+['\"]?%\w+%['\"]?"
    r"|php(\.exe)?\s+-[rv]"
    r"|php-cgi(\.exe)?\s+-b"
)
INSTALLER_PARENT = r"install[/\\]install\.php"
XAMPP_PATH = r"[/\\]xampp[/\\]"
XAMPP_TOOL = r"^(awk|sed|grep|gzip|perl|php|mysqld?|httpd)\.exe$"
CMD_WRAPPER = r"^cmd(\.exe)?$"
FIRST_EXE = r"([\w]+\.exe)"
NET_USER_ADD = r"net\d?\s+user\s+([^\s/]+).*?/add\b"
SCHTASKS_CREATE = r"schtasks\s+/create\b.*?/tn[\s:]+['\"]?([^'\"\s/]+)"
REG_RUN_ADD = r"reg\s+add\b.*?\\run\b.*?/v[\s:]+['\"]?([^'\"\s/]+)"

# ---------------------------------------------------------- script blocks (fixed values)
SUSPICIOUS_SCRIPT = (
    r"(invoke-expression|iex\s*[\(\$]"
    r"|invoke-webrequest|downloadstring|downloadfile"
    r"|net\.webclient"
    r"|frombase64string|[Cc]onvert::[Ff]rom[Bb]ase64"
    r"|-encodedcommand|-enc\s"
    r"|add-mppreference\s+-exclusion"
    r"|set-mppreference.*disablerealtimemonitoring"
    r"|invoke-mimikatz|sekurlsa|lsadump"
    r"|new-object\s+system\.net\.sockets"
    r"|\$env:temp.*\.exe"
    r"|start-process.*hidden"
    r"|-windowstyle\s+hidden|-w\s+hidden)"
)

# ---------------------------------------------------------- registry (fixed values)
RUN_KEY = (
    r"(\\currentversion\\run$|\\currentversion\\runonce$"
    r"|\\currentversion\\runservices$)"
)
DEFENDER_EXCLUSION = r"windows defender.*(exclusion|disabled|real.?time)"
RUN_DATA_PATH = (
    r"(\\temp\\|\\tmp\\|\\appdata\\local\\temp\\"
    r"|\\users\\public\\|\\programdata\\"
    r"|\\windows\\temp\\|%temp%|%appdata%)"
)
RUN_DATA_WEB_PATH = (
    r"(\\htdocs\\|\\wwwroot\\|\\inetpub\\|\\uploads\\"
    r"|/htdocs/|/wwwroot/|/uploads/)"
)
RUN_DATA_COMMAND = (
    r"(powershell|cmd|wscript|mshta|rundll32|certutil)"
    r".*(hidden|windowstyle|-enc|-w\s+hidden|bypass)"
)
SERVICE_KEY = r"currentcontrolset\services"
SERVICE_EXTENSION = r"\.(exe|dll|bat|ps1|vbs|msi|scr|com|pif|cmd)(\s|\"|\\'|$)"
SERVICE_PATH = (
    r"(\\temp\\|\\tmp\\|\\users\\public\\"
    r"|cmd\.exe|powershell\.exe|wscript\.exe"
    r"|certutil|mshta|rundll32)"
)
LEGITIMATE_SERVICE = (
    r"^(\.(net|wow|clr)|(wlan|audio|event|print|rpc|dns|dhcp"
    r"|bits|w32|spooler|lanman|netlogon|plug))"
)

# ---------------------------------------------------------- files (fixed values)
DROP_PATH = (
    r"(\\temp\\|\\tmp\\|\\appdata\\local\\temp\\"
    r"|\\users\\public\\|\\programdata\\"
    r"|\\windows\\temp\\"
    r"|\\inetpub\\wwwroot\\|\\xampp\\htdocs\\"
    r"|\\apache-tomcat\\|\\uploads\\)"
)
DROP_EXTENSION = r"\.(exe|dll|bat|ps1|vbs|msi|scr|com|pif)$"
DROP_BENIGN_PROCESS = (
    r"^(dismhost|tiworker|mscorsvw|taskhostw"
    r"|sdiagnhost|msiexec|trustedinstaller)(\.exe)?$"
)
DROP_BENIGN_PATH = (
    r"(\\\$winreagent\\"
    r"|\\winsxs\\temp\\"
    r"|\\assembly\\nativeimages_"
    r"|\\temp\\sdiag_"
    r"|__psscriptpolicytest_)"
)
SENSITIVE_EXTENSION = (
    r"\.(db|sqlite|sqlite3|sql|mdb|ldf|mdf|"
    r"bak|backup|dump|"
    r"config|cfg|ini|env|"
    r"exe|dll|ps1|bat|cmd|vbs|js|hta)$"
)
SENSITIVE_PATH = r"\\(htdocs|wwwroot|inetpub|xampp|www|webroot|uploads|public_html)\\"
SYSTEM_DRIVE_PATH = r"^[A-Za-z]:\\(Windows|Program Files|ProgramData)\\"

# ---------------------------------------------------------- scheduled tasks (fixed values)
TASK_DATASET = "windows.scheduled_tasks"
TASK_PATH = (
    r"(\\htdocs\\|\\wwwroot\\|\\inetpub\\|\\uploads\\|\\xampp\\"
    r"|\\temp\\|\\tmp\\|\\appdata\\local\\temp\\"
    r"|\\downloads\\|\\public\\|\\users\\public\\)"
)
TASK_HIDDEN_PS = (
    r"(powershell|pwsh).*"
    r"(-windowstyle\s+hidden|-w\s+hidden|-enc\s|-encodedcommand"
    r"|iex\s*[\(\$]|invoke-expression|downloadstring|frombase64string"
    r"|-nop\s|-noprofile\s|-exec\s+bypass)"
)
TASK_MASQUERADE = (
    r"^(windowsupdate|windows.?update|svchost|system32|winsvc"
    r"|microsoftupdate|windows.?defender|winlogon|lsass"
    r"|csrss|updater|update|maintenance|security.?center)$"
)
TASK_LEGIT_PREFIX = r"\\Microsoft\\Windows\\"
TASK_LOLBIN = (
    r"(certutil|bitsadmin|mshta|wscript|cscript|regsvr32|rundll32"
    r"|msiexec|wmic|forfiles|pcalua|presentationhost)\.exe"
)
WINDOWS_DIR = r"(%windir%|%systemroot%|c:\\windows)"
RUNDLL_TARGET = r"rundll32(?:\.exe)?\s+(?:[/\-][dD]\s+)?([^,\s]+)"
RUNDLL_SWITCH = r"^[/\-][dD]\s+"
KNOWN_SYSTEM_DLL = (
    r"^(?:acproxy|sysmain|bfe|dfdts|startupscan|pcasvc|wmpnscfg|"
    r"appxdeploymentclient|capabilityaccessmanager|"
    r"windows\.staterepositoryc|pcrpf|"
    r"windows\.storage\.applicationdata)\.dll$"
)
TASK_SYSTEM_PATH = (
    r"(%windir%|%systemroot%|c:\\windows|c:\\program files"
    r"|%programfiles%|c:\\programdata\\microsoft\\windows defender"
    r"|onedrive|microsoftedge|edgeupdate)"
)
INTERPRETERS = (
    "powershell", "powershell.exe", "pwsh", "cmd", "cmd.exe",
    "wscript", "cscript", "mshta", "rundll32",
)
CREATED_TASK_LEGIT_PATH = (
    r"^(\\microsoft\\|\\windows\\"
    r"|%systemroot%\\|%windir%\\"
    r"|%localappdata%\\microsoft\\onedrive\\"
    r"|%programfiles%\\|%programfiles\(x86\)%\\)"
)
# The leading backslash is optional: normalised task names have lost it.
CREATED_TASK_LEGIT_COM = (
    r"^\\?PostponeDeviceSetupToast_S-1-5-.*"
    r"|^\\?SoftLanding\\?S-1-5-.*"
)

# ---------------------------------------------------------- WMI (fixed values)
WMI_SUSPICIOUS = (
    r"(powershell|cmd\.exe|wscript|mshta|certutil"
    r"|downloadstring|iex\s*\(|encodedcommand"
    r"|-enc\s|-windowstyle\s+hidden|bypass)"
)
WMI_LEGITIMATE = (
    r"(SCM Event Log Filter|NTEventLogEventConsumer"
    r"|BVTFilter|TSlogonEvents|RAevent)"
)

# ---------------------------------------------------------- web (fixed values)
SQL_INJECTION = (
    r"(union\s+select|select\s+.+from|insert\s+into|drop\s+table"
    r"|or\s+1\s*=\s*1|and\s+1\s*=\s*1|'\s*or\s*'|--\s|;--"
    r"|xp_cmdshell|information_schema|sleep\s*\(|benchmark\s*\()"
)
COMMAND_INJECTION = (
    r"(;|\||&&|\$\(|`)\s*(ls|cat|id|whoami|uname|wget|curl"
    r"|nc\s|ncat\s|bash|sh\s|python|perl|php)"
)
PATH_TRAVERSAL = (
    r"(\.\./|\.\.\\|%2e%2e%2f|%252e%252e|/etc/passwd"
    r"|/etc/shadow|/proc/self|boot\.ini|win\.ini"
    r"|file://|php://|zip://|data://)"
)
SCRIPT_INJECTION = (
    r"(<script|javascript:|onerror\s*=|onload\s*=|alert\s*\("
    r"|document\.cookie|<iframe|<img[^>]+src\s*=)"
)
UPLOAD_NAME = r"(shell|backdoor|cmd|exec|payload|inject|exploit)"
UPLOAD_SCRIPT_EXTENSION = r"\.(php|php5|php7|phtml|phar|asp|aspx|jsp|jspx)(\?|&|$)"
UPLOAD_DIR = r"/(upload|uploads|files|media|images|img|static|assets|tmp|temp)/"
UPLOAD_EXECUTABLE = r"\.(exe|dll|bat|ps1|vbs|vbe|msi|bin|elf|sh|py|rb|pl)(\?|&|$|%)"
UPLOAD_HIGH_RISK = r"\.(exe|dll|bat|ps1|vbs|msi)(\?|&|$|%)"
WEBSHELL_COMMAND = (
    r"(cmd|exec|command|shell|run|system|passthru|eval)\s*=\s*"
    r".*(whoami|net[\+%20]+(user|localgroup)|ipconfig|systeminfo"
    r"|dir[\+%20]|ls[\+%20]|cat[\+%20]|id|uname|hostname"
    r"|tasklist|netstat|wget|curl|powershell)"
)
SCANNER_AGENT = (
    r"(sqlmap|nikto|nmap|masscan|dirbuster|gobuster|wfuzz"
    r"|burpsuite|hydra|medusa|nessus|openvas|nuclei|zgrab"
    r"|python-requests|python-urllib|curl|wget|go-http-client)"
)
BODY_METACHARACTER_CS = r"[|;&`$]|\$\(|%0a|\n"
BODY_COMMAND = (
    r"\b("
    r"net\s+(user|localgroup|group)|"
    r"whoami|systeminfo|ipconfig|ifconfig|hostname|"
    r"powershell(\.exe)?|cmd(\.exe)?(\s+/c)?|"
    r"wget|curl|certutil|bitsadmin|"
    r"nc(\.exe)?\s|netcat|ncat|"
    r"cat\s+/etc/passwd|/bin/(ba)?sh|/bin/dash|"
    r"ping\s+-[nc]\s|"
    r"reg\s+(add|query|delete)|schtasks|"
    r"wmic|rundll32|mshta|"
    r"tasklist|taskkill|"
    r"echo\s.*>\s|type\s+nul|"
    r"base64\s+-d|certutil\s+-decode"
    r")\b"
)
FILE_PARAMS = ("page", "file", "path", "include", "load")
COMMAND_PARAMS = ("cmd", "exec", "command", "shell", "run", "system", "passthru", "eval")
SESSION_COOKIES = (
    r"PHPSESSID=([a-zA-Z0-9]+)",
    r"ASP\.NET_SessionId=([a-zA-Z0-9]+)",
    r"JSESSIONID=([a-zA-Z0-9.\-]+)",
    r"connect\.sid=([^;]+)",
)
IP_MATCH_WINDOW_SECONDS = 10

# ---------------------------------------------------------- log lines (fixed values)
ACCESS_LINE = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) \S+" (\d{3}) (\S+) "([^"]*)" "([^"]*)"$'
)
ERROR_LINE = (
    r"^\[(\w{3} \w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}\.\d+ \d{4})\] \[([^\]]+)\] "
    r"\[([^\]]+)\] (?:\[client ([^\]]+)\] )?(.+)$"
)
ACCESS_LINE_DATE = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})"
ERROR_LINE_DATE = r"\[\w{3} (\w{3} \d{1,2} \d{2}:\d{2}:\d{2})\.\d+ (\d{4})\]"
DUMP_REQUEST_LINE = r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT)\s"
DUMP_PAYLOAD = r"\(data-HEAP\):\s*(.*)$"
DUMP_SIZE_ONLY = r"^\d+\s+bytes\s*$"
DUMP_CLIENT = r"\[client\s+([\d.]+):(\d+)\]"

# ---------------------------------------------------------- normalisation (fixed values)
DEFAULT_LOOKBACK_HOURS = 48
SECURITY_EVENT_IDS = (4624, 4625, 4688, 4698, 4702, 4720, 4732)
SYSTEM_CRITICAL_IDS = (7045, 7040, 104, 6008, 6005, 6006)
ERROR_LEVELS = (2, 3)
EARLIEST_MS_DATE = 946684800000
EXECUTABLE_EXTENSIONS = ("exe", "bat", "cmd", "ps1", "vbs", "js", "msc", "com", "scr", "dll")
BARE_BINARIES = (
    "powershell", "pwsh", "cmd", "wscript", "cscript", "mshta",
    "certutil", "bitsadmin", "rundll32", "regsvr32", "wmic", "net",
    "reg", "sc", "schtasks", "msiexec", "forfiles", "whoami", "ping",
)
SUSPICIOUS_PIPES = (
    "\\postex_",
    "\\msagent_",
    "mojo.5688.",
    "\\isapi_http",
    "\\isapi_dg",
    "\\wkssvc_",
    "\\ntsvcs",
    "\\scerpc_",
    "\\mepipe",
    "\\meterpreter",
    "\\psexec",
    "\\paexec",
    "\\remcom",
)

# ---------------------------------------------------------- rule catalogue (fixed values)
# id, name, kind, severity, confidence, technique id, technique name, tactic, phase, tags,
# source; severity or confidence is None where the rule works it out per row.
RULE_CATALOG = (
    ("WIN_USER_CREATED_001", "User Account Created", "per_event", "high", 0.95, "T1136.001", "Create Account: Local Account", "persistence", "installation", ("account", "persistence"), "windows_events"),
    ("WIN_GROUP_ADD_001", "User Added to Privileged Group", "per_event", "high", 0.97, "T1098", "Account Manipulation", "privilege_escalation", "exploitation", ("privilege_escalation", "account"), "windows_events"),
    ("WIN_REMOTE_LOGIN_001", "Remote Interactive Logon", "per_event", "high", 0.85, "T1021", "Remote Services", "lateral_movement", "command_and_control", ("remote_logon", "lateral_movement", "valid_accounts"), "windows_events"),
    ("NET_SUSPICIOUS_LISTENER_001", "Suspicious Process Listening", "per_event", "critical", 0.92, "T1571", "Non-Standard Port", "command_and_control", "command_and_control", ("backdoor", "listening", "network", "live"), "network"),
    ("NET_SUSPICIOUS_PORT_001", "Suspicious Port Listening", "per_event", "high", 0.85, "T1571", "Non-Standard Port", "command_and_control", "command_and_control", ("reverse_shell", "listening", "network", "live"), "network"),
    ("NET_REVERSE_SHELL_001", "Active Reverse Shell Connection", "per_event", "critical", 0.93, "T1059", "Command and Scripting Interpreter", "command_and_control", "command_and_control", ("reverse_shell", "established", "network", "live"), "network"),
    ("NET_SUSPICIOUS_OUTBOUND_001", "Suspicious Process Outbound Connection", "per_event", "high", 0.78, "T1071.001", "Application Layer Protocol: Web Protocols", "command_and_control", "command_and_control", ("outbound", "c2", "network", "live"), "network"),
    ("NET_SUSPICIOUS_SSH_001", "Inbound SSH Connection", "per_event", "medium", 0.75, "T1021.004", "Remote Services: SSH", "lateral_movement", "command_and_control", ("ssh", "inbound", "network", "live"), "network"),
    ("NET_WEBSERVER_INBOUND_001", "Web Server Inbound Connection", "per_event", "info", 0.95, "T1190", "Exploit Public-Facing Application", "initial_access", "exploitation", ("provenance", "web", "network", "anchor"), "network"),
    ("PROC_SUSPICIOUS_001", "Suspicious Process Execution", "per_event", "high", 0.85, "T1059", "Command and Scripting Interpreter", "execution", "exploitation", ("process", "cmdline"), "process"),
    ("PROC_WEBSHELL_CHILD_001", "Webshell Child Process", "per_event", "critical", 0.95, "T1505.003", "Web Shell", "execution", "exploitation", ("webshell", "process"), "process"),
    ("WIN_SUSPICIOUS_CMDLINE_001", "Suspicious Command Line Execution", "per_event", "high", 0.85, "T1059", "Command and Scripting Interpreter", "execution", "exploitation", ("execution", "cmdline"), "process"),
    ("WIN_CMD_USER_CREATION_001", "Local Account Created via Command", "per_event", "high", 0.90, "T1136.001", "Create Account: Local Account", "persistence", "installation", ("account", "persistence", "cmdline"), "process"),
    ("WIN_CMD_PERSISTENCE_ARTIFACT_001", "Persistence Artifact Created via Command", "per_event", "high", 0.88, None, None, "persistence", "installation", ("persistence", "cmdline"), "process"),
    ("REG_RUNKEY_001", "Suspicious Run Key Entry", "per_event", None, None, "T1547.001", "Boot or Logon Autostart: Registry Run Keys", "persistence", "installation", ("persistence", "registry", "run_key"), "registry"),
    ("REG_DEFENDER_EXCLUSION_001", "Windows Defender Exclusion in Registry", "per_event", "critical", 0.95, "T1562.001", "Impair Defenses: Disable or Modify Tools", "defense_evasion", "installation", ("defense_evasion", "defender", "registry"), "registry"),
    ("REG_SUSPICIOUS_SERVICE_001", "Suspicious Service Registry Entry", "per_event", "high", 0.85, "T1543.003", "Create or Modify System Process: Windows Service", "persistence", "installation", ("persistence", "service", "registry"), "registry"),
    ("WIN_LOG_CLEARED_001", "Event Log Cleared", "per_event", "critical", 1.0, "T1070.001", "Indicator Removal: Clear Windows Event Logs", "defense_evasion", "actions_on_objectives", ("defense_evasion", "anti_forensics"), "windows_events"),
    ("SYS_SUSPICIOUS_FILE_DROP_001", "File Dropped in Suspicious Location", "per_event", "high", 0.88, "T1105", "Ingress Tool Transfer", "command_and_control", "installation", ("file_drop", "executable", "sysmon"), "sysmon"),
    ("WIN_SENSITIVE_FILE_DELETE_001", "Sensitive File Deletion", "per_event", "high", 0.85, "T1485", "Data Destruction", "impact", "actions_on_objectives", ("file_deletion", "sensitive_file", "anti_forensics", "impact"), "sysmon"),
    ("WIN_SYSTEM_FILE_DELETE_001", "System File Deletion", "per_event", "critical", 0.9, "T1485", "Data Destruction", "impact", "actions_on_objectives", ("file_deletion", "system_file", "defense_evasion", "impact"), "sysmon"),
    ("TASK_WEBROOT_EXEC_001", "Scheduled Task Executes from Web Root", "per_event", "critical", 0.97, "T1053.005", "Scheduled Task/Job: Scheduled Task", "persistence", "installation", ("scheduled_task", "webshell", "persistence", "web_root"), "scheduled_tasks"),
    ("TASK_PS_HIDDEN_001", "Scheduled Task with Hidden PowerShell", "per_event", "high", 0.92, "T1053.005", "Scheduled Task/Job: Scheduled Task", "execution", "installation", ("scheduled_task", "powershell", "hidden", "evasion"), "scheduled_tasks"),
    ("TASK_MASQUERADE_001", "Scheduled Task Masquerading as System Process", "per_event", "high", 0.85, "T1036.004", "Masquerading: Match Legitimate Name or Location", "defense_evasion", "installation", ("scheduled_task", "masquerade", "evasion", "persistence"), "scheduled_tasks"),
    ("TASK_LOLBIN_001", "Scheduled Task Uses LOLBin", "per_event", "medium", 0.80, "T1218", "System Binary Proxy Execution", "defense_evasion", "installation", ("scheduled_task", "lolbin", "defense_evasion"), "scheduled_tasks"),
    ("WIN_SCHTASK_CREATED_001", "Suspicious Scheduled Task Created", "per_event", None, None, "T1053.005", "Scheduled Task/Job: Scheduled Task", "persistence", "installation", ("persistence", "scheduled_task"), "process"),
    ("WMI_SUBSCRIPTION_001", "WMI Event Subscription Created", "per_event", None, None, "T1546.003", "Event Triggered Execution: WMI Event Subscription", "persistence", "installation", ("persistence", "wmi", "subscription"), "wmi"),
    ("WEB_SQLI_001", "SQL Injection Attempt", "per_event", "high", 0.85, "T1190", "Exploit Public-Facing Application", "initial_access", "exploitation", ("sqli", "web", "injection"), "web_logs"),
    ("WEB_LFI_001", "Path Traversal / LFI Attempt", "per_event", "high", 0.90, "T1055", "Path Traversal", "initial_access", "delivery", ("lfi", "traversal", "web"), "web_logs"),
    ("WEB_CMDI_001", "Command Injection Attempt", "per_event", "critical", 0.88, "T1059", "Command and Scripting Interpreter", "execution", "exploitation", ("cmdi", "web", "rce"), "web_logs"),
    ("WEB_XSS_001", "XSS Attempt", "per_event", "medium", 0.80, "T1189", "Drive-by Compromise", "initial_access", "exploitation", ("xss", "web"), "web_logs"),
    ("WEB_WEBSHELL_UPLOAD_001", "Webshell Upload Attempt", "per_event", "critical", None, "T1505.003", "Web Shell", "persistence", "installation", ("webshell", "upload", "web"), "web_logs"),
    ("WEB_WEBSHELL_EXEC_001", "Webshell Command Execution", "per_event", "critical", 0.95, "T1505.003", "Web Shell", "execution", "exploitation", ("webshell", "rce", "execution", "web"), "web_logs"),
    ("WEB_MALICIOUS_UPLOAD_001", "Malicious Executable Upload", "per_event", None, None, "T1608.001", "Upload Malware", "initial_access", "delivery", ("upload", "malware", "executable", "web"), "web_logs"),
    ("WEB_WEBSHELL_EXEC_002", "Suspicious Command in POST Body", "per_event", "critical", 0.85, "T1505.003", "Web Shell", "execution", "exploitation", ("webshell", "rce", "execution", "web", "post_body"), "web_logs"),
    ("WIN_BRUTE_FORCE_001", "Brute Force Login Attempt", "aggregate", "high", 0.90, "T1110.001", "Brute Force: Password Guessing", "credential_access", "exploitation", ("bruteforce", "authentication"), "windows_events"),
    ("NET_ARP_POISONING_001", "ARP Poisoning Detected", "aggregate", "high", 0.85, "T1557.002", "ARP Cache Poisoning", "lateral_movement", "exploitation", ("arp", "poisoning", "network", "live"), "network"),
    ("PROC_SUSPICIOUS_CMDLINE_001", "Suspicious Command Line", "aggregate", "high", 0.80, "T1059", "Command and Scripting Interpreter", "execution", "exploitation", ("cmdline", "process", "lotl"), "process"),
    ("PS_ORPHANED_SCRIPTBLOCK_001", "Orphaned Script Block — No Completion Event", "aggregate", "medium", 0.70, "T1059.001", "PowerShell", "defense_evasion", "exploitation", ("powershell", "scriptblock", "terminated"), "powershell"),
    ("PS_CONFIRMED_SUSPICIOUS_EXEC_001", "Confirmed Suspicious Script Block Execution", "aggregate", "critical", 0.93, "T1059.001", "PowerShell", "execution", "exploitation", ("powershell", "scriptblock", "confirmed", "execution"), "powershell"),
    ("WIN_MASS_FILE_DELETE_001", "Mass File Deletion", "aggregate", "high", 0.8, "T1485", "Data Destruction", "impact", "actions_on_objectives", ("file_deletion", "mass_deletion", "anti_forensics", "impact"), "sysmon"),
    ("TASK_NON_SYSTEM_EXEC_001", "Scheduled Task with Non-System Executable", "aggregate", "medium", 0.72, "T1053.005", "Scheduled Task/Job: Scheduled Task", "persistence", "installation", ("scheduled_task", "persistence", "non_standard_path"), "scheduled_tasks"),
    ("WEB_BRUTE_FORCE_001", "Web Brute Force", "aggregate", "medium", None, "T1110", "Brute Force", "credential_access", "delivery", ("bruteforce", "web", "auth"), "web_logs"),
    ("WEB_RECON_SCAN_001", "Web Directory Scanning", "aggregate", "medium", 0.85, "T1595.003", "Wordlist Scanning", "initial_access", "reconnaissance", ("recon", "scanning", "web"), "web_logs"),
    ("WEB_SCANNER_UA_001", "Known Scanner Detected", "aggregate", "medium", 0.95, "T1595", "Active Scanning", "initial_access", "reconnaissance", ("scanner", "recon", "web"), "web_logs"),
    ("WEB_LOGIN_SUCCESS_AFTER_BF_001", "Successful Login After Brute Force", "aggregate", "high", 0.92, "T1110", "Brute Force", "credential_access", "delivery", ("bruteforce", "login", "success", "web"), "web_logs"),
)
