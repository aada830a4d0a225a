"""Hand-written hits and near misses of each detection pattern, so that values are checked and not only plans."""

import pytest
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x

# pattern: (texts that must match, near misses that must not)
CASES = {
    "LISTENER_PROCESS": (["cmd.exe", "PowerShell", "nc"], ["cmd.exe.bak", "xcmd.exe", "ncat2.exe", ""]),
    "INBOUND_WEB_SERVER": (["httpd.exe", "apache2", "W3WP.exe"], ["httpd-proxy.exe", "apache3", "nginx.exe2"]),
    "WATCHED_PROCESS": (["net1.exe", "schtasks", "reg.exe"], ["net2.exe", "regedit.exe", "whoami.com"]),
    "SUSPICIOUS_COMMAND": (
        ["net user bob", "NET LOCALGROUP administrators", "schtasks /create /tn x", "powershell -enc AA", "IEX (x)", "-w hidden"],
        ["net use bob", "net localgroup users", "schtasks /query", "-encoding utf8", "iexplore", "-w normal"],
    ),
    "WEB_SERVER_PARENT": (["httpd.exe", "tomcat"], ["tomcat9.exe", "lighttpd"]),
    "INSTALLER_PARENT": (["c:\\xampp\\install\\install.php"], ["install.php", "c:\\install\\setup.php"]),
    "NET_USER_ADD": (["net user eve p /add", "net1  user eve /ADD"], ["net user eve /delete", "net user eve /added"]),
    "SCHTASKS_CREATE": (["schtasks /create /sc daily /tn 'job'"], ["schtasks /create /sc daily", "schtasks /creates /tn j"]),
    "REG_RUN_ADD": (["reg add hkcu\\a\\run /v evil"], ["reg add hkcu\\a\\runs /v evil", "reg query hkcu\\a\\run /v evil"]),
    "SUSPICIOUS_SCRIPT": (
        ["IEX $x", "(new-object Net.WebClient)", "$env:temp\\a.exe", "Invoke-Mimikatz"],
        ["iexpress $x", "$env:tmp\\a.exe", "web client", "set-mppreference -x"],
    ),
    "RUN_KEY": (["hkcu\\currentversion\\run", "hklm\\CurrentVersion\\RunOnce"], ["hkcu\\currentversion\\run\\x", "hkcu\\currentversion\\runner"]),
    "DEFENDER_EXCLUSION": (["hklm\\Windows Defender\\Exclusions\\Paths"], ["hklm\\windows defender\\scan", "hklm\\exclusions"]),
    "RUN_DATA_PATH": (["c:\\temp\\a", "%APPDATA%\\x", "c:\\users\\public\\a"], ["c:\\temporary\\a", "c:\\users\\publicist\\a"]),
    "RUN_DATA_WEB_PATH": (["c:\\inetpub\\x", "/uploads/x"], ["c:\\inetpubs\\x", "uploads/x"]),
    "RUN_DATA_COMMAND": (["powershell -w hidden", "mshta x bypass"], ["powershell -w normal", "hidden powershell"]),
    "LEGITIMATE_SERVICE": ([".NET x", "wlansvc", "spooler"], ["xwlansvc", "net"]),
    "DROP_PATH": (["c:\\windows\\temp\\a", "c:\\inetpub\\wwwroot\\a"], ["c:\\windows\\system32\\a", "c:\\inetpub\\logs\\a"]),
    "DROP_EXTENSION": (["a.exe", "a.PS1"], ["a.exe.txt", "aexe", "a.js"]),
    "DROP_BENIGN_PROCESS": (["tiworker.exe", "msiexec"], ["tiworker2.exe", "xmsiexec"]),
    "SENSITIVE_EXTENSION": (["a.sqlite3", "a.bak", "a.HTA"], ["a.sqlite4", "a.bak.zip", "a.mp3"]),
    "SENSITIVE_PATH": (["c:\\www\\a", "d:\\public_html\\a"], ["c:\\www2\\a", "www\\a"]),
    "SYSTEM_DRIVE_PATH": (["c:\\windows\\a", "D:\\Program Files\\a"], ["c:\\windows.old\\a", "\\\\srv\\c:\\windows\\a"]),
    "TASK_PATH": (["c:\\xampp\\a", "c:\\downloads\\a"], ["c:\\xampp2\\a", "c:\\download\\a"]),
    "TASK_HIDDEN_PS": (["pwsh -noprofile x", "powershell iex $a"], ["powershell -profile x", "cmd -noprofile x"]),
    "TASK_MASQUERADE": (["svchost", "Windows Update", "updater"], ["svchost2", "my updater", "updates"]),
    "TASK_LOLBIN": (["c:\\certutil.exe -x", "RUNDLL32.EXE"], ["certutil -x", "rundll.exe"]),
    "WINDOWS_DIR": (["%WinDir%\\a", "C:\\Windows\\a"], ["%temp%\\a", "d:\\windows\\a"]),
    "KNOWN_SYSTEM_DLL": (["sysmain.dll", "BFE.dll"], ["sysmain.dll.bak", "xbfe.dll"]),
    "SQL_INJECTION": (["/a?id=1 union select x"], ["/a?id=union", "/select/union"]),
    "PATH_TRAVERSAL": (["/a?f=../../etc/passwd"], ["/a?f=etc-passwd", "/a/b.txt"]),
    "SCRIPT_INJECTION": (["/a?q=<script>alert(1)"], ["/a?q=script", "/scripts/a.js"]),
    "UPLOAD_NAME": (["/shell.x", "/my-BACKDOOR"], ["/shel", "/back-door"]),
    "UPLOAD_SCRIPT_EXTENSION": (["/a.php", "/a.phtml?x", "/a.jsp&b"], ["/a.phps", "/php", "/a.php/b"]),
    "UPLOAD_DIR": (["/uploads/a", "/tmp/a"], ["/uploaded/a", "uploads/a"]),
    "UPLOAD_EXECUTABLE": (["/a.exe", "/a.sh?x", "/a.py%20"], ["/a.exec", "/exe", "/a.shtml"]),
    "UPLOAD_HIGH_RISK": (["/a.dll"], ["/a.sh", "/a.py"]),
}


@pytest.fixture(scope="module")
def matched(spark):
    """``(pattern, text)`` pairs that match, evaluated as the rules do."""
    found = set()
    for name, (hits, misses) in CASES.items():
        df = spark.createDataFrame([(t,) for t in [*hits, *misses]], "t string")
        found |= {(name, r["t"]) for r in df.where(x.matches(F.col("t"), getattr(fv, name))).collect()}
    return found


@pytest.mark.parametrize("name", sorted(CASES))
def test_pattern(matched, name):
    hits, misses = CASES[name]
    assert [t for t in hits if (name, t) not in matched] == []
    assert [t for t in misses if (name, t) in matched] == []


def test_fixed_numbers():
    """Ports, thresholds and windows written out a second time."""
    assert set(fv.SUSPICIOUS_PORTS) == {
        4444, 4445, 4446, 1234, 5555, 5554, 8888, 9001, 9999, 6666, 2222, 31337, 1337, 8080, 8443, 8000,
    }
    assert fv.EPHEMERAL_PORT_START == 49152 and fv.REMOTE_LOGON_TYPES == (3, 8, 10)
    assert len(fv.RULE_CATALOG) == 46 and len({r[0] for r in fv.RULE_CATALOG}) == 46
