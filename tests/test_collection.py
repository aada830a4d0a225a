"""Collection documents through sources, normalisation, storage and streaming."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from casegraph.operators.reassembly import dump_chunks, reassemble
from casegraph.plans.detect import RuleSet, detect
from casegraph.plans.investigate import match_request_ips, match_stats, normalize, web_events
from casegraph.plans.normalize_snapshots import normalize_access, normalize_requests
from casegraph.plans.normalize_windows import unparsed
from casegraph.session import cut_lineage
from casegraph.sources import collection as src
from casegraph.sources import tables
from casegraph.sources.integrity import file_hashes, verify_integrity
from casegraph.sources.weblogs import read_access_log, read_error_log

STAMP = "Mon Jan 01 10:00:0{s}.000000 2024"


def dump(second, client, payload):
    return {
        "timestamp": STAMP.format(s=second), "level": "dumpio:trace7", "module": "dumpio", "client": client,
        "message": f"mod_dumpio:  dumpio_in (data-HEAP): {payload}",
    }


DUMPS = [
    dump(0, "10.0.0.9:1", "stray body"),
    dump(1, "10.0.0.9:1", "POST /up.php HTTP/1.1\\r\\nContent-Le"),
    dump(1, "10.0.0.8:2", "GET /a HTTP/1.1\\r\\nCookie: PHPSESSID=abc\\r\\n\\r\\n"),
    dump(2, "10.0.0.9:1", "ngth: 10\\r\\n\\r"),
    dump(2, "10.0.0.9:1", "12 bytes"),
    dump(3, "10.0.0.9:1", "\\ncmd=a"),
    dump(4, "10.0.0.9:1", "GET xy"),
    dump(5, "10.0.0.9:1", "POST /b HTTP/1.1\\r\\nContent-Length: 99\\r\\n\\r\\nshort"),
]

DOCUMENT = {
    "metadata": {"hostname": "PC1", "collected_at": "2024-01-02T00:00:00Z", "os_version": "10"},
    "modules": {
        "event_logs": {
            "security": [
                {"time_created": "2024-01-01T10:00:00Z", "event_id": 4720, "message": "m",
                 "event_data": {"TargetUserName": "Evil", "TargetDomainName": "PC1", "TargetSid": "S-1-5-21-9"}},
                {"time_created": "2024-01-01T10:01:00Z", "event_id": 4732, "message": "m",
                 "event_data": {"TargetUserName": "Administrators", "MemberSid": "S-1-5-21-9"}},
                {"time_created": "2024-01-01T10:02:00Z", "event_id": 4624, "message": "m",
                 "event_data": {"TargetUserName": "evil", "TargetUserSid": "S-1-5-21-9", "LogonType": "10",
                                "TargetLogonId": "0xAB", "IpAddress": "10.0.0.9"}},
                {"time_created": "2024-01-01T10:03:00Z", "event_id": 4698, "message": "m", "event_data": {
                    "TaskName": "\\Bad", "TaskContent":
                    "<Task xmlns=\"http://schemas.microsoft.com/windows/2004/02/mit/task\"><Actions><Exec>"
                    "<Command>C:\\x\\run.exe</Command><Arguments>-A b</Arguments></Exec></Actions></Task>"}},
                {"time_created": "2024-01-01T10:03:00Z", "event_id": 9999, "message": "m", "event_data": {}},
            ],
            "sysmon": [
                {"time_created": "2024-01-01T10:04:00Z", "event_id": 26, "message": "m", "hostname": "PC1",
                 "event_data": {"TargetFilename": "C:\\data\\a.sql", "LogonId": "0xab", "ProcessGuid": "{1}"}},
                {"time_created": "2024-01-01T10:04:01Z", "event_id": 22, "message": "m",
                 "event_data": {"QueryName": "Evil.com", "QueryResults": "1.1.1.1; 2.2.2.2;"}},
            ],
            "wmi": {"time_created": "2024-01-01T10:00:00Z", "event_id": 5857,
                    "message": "CIMWin32 provider started with result code 0x0. HostProcess = wmiprvse.exe; ProcessID = 12; ProviderPath = %x%\\y.dll"},
            "application": None,
        },
        "processes": {"processes": [
            {"name": "cmd.exe", "pid": 5, "parent_pid": 0, "owner": "PC1\\bob", "hash_sha256": "no_path",
             "start_time": "unknown", "executable_path": "C:\\cmd.exe", "command_line": "cmd /c \"dir\""}]},
        "network": {"tcp_connections": {"local_address": "10.0.0.1", "local_port": 4444, "remote_address": "10.0.0.2",
                                        "remote_port": 80, "state": "Established", "pid": 4, "process_name": "nc"},
                    "arp_cache": None, "udp_endpoints": [{"local_address": "0.0.0.0", "local_port": 53, "pid": 1}]},
        "registry": {"data": {
            "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run": [{"name": "Evil", "value": "C:\\Users\\Public\\e.exe"}],
            "HKLM\\SYSTEM\\CurrentControlSet\\Services": {"name": "svc", "imagepath": "\"C:\\a b\\s.exe\" -k x"}}},
        "scheduled_tasks": {"tasks": [
            {"task_name": "\\Updater", "actions": "C:\\xampp\\htdocs\\a.bat", "last_run": "/Date(1700000000000)/", "last_result": 0},
            {"task_name": "Two", "actions": ["a.exe -x", "b.exe"], "last_run": "/Date(1)/"}]},
        "web_logs": {"data": {
            "access.log": {"log_type": "access", "count": 1, "entries": [
                {"client_ip": "10.0.0.9", "timestamp": "01/Jan/2024:11:00:00 +0100", "method": "GET", "path": "/a?x=../../etc/passwd",
                 "status_code": 200, "bytes": 5, "referer": "-", "user_agent": "curl/8"}]},
            "error.log": {"log_type": "error", "count": 1, "entries": [
                {"timestamp": STAMP.format(s=9), "level": "core:error", "module": "core", "client": "::1:55", "message": "File missing"},
                *DUMPS]}}},
    },
    "module_hashes": {"registry": "AB"},
}


@pytest.fixture(scope="module")
def collections(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("collections")
    (folder / "pc1.json").write_text(json.dumps(DOCUMENT))
    return cut_lineage(src.read_collections(spark, str(folder)))


@pytest.fixture(scope="module")
def events(collections):
    return cut_lineage(normalize(collections))


def test_channels_and_counts(events):
    counts = {r["channel"]: r["count"] for r in events.groupBy("channel").count().collect()}
    assert counts == {
        "security": 4, "sysmon": 2, "wmi": 1, "processes": 1, "network": 2, "registry": 2,
        "scheduled_tasks": 3, "web_logs": 4,
    }


def test_values(events):
    rows = {(r["channel"], r["event"]["action"]): r for r in events.collect()}
    dns = rows["sysmon", "dns_query"]
    assert [a["data"] for a in dns["dns"]["answers"]] == ["1.1.1.1", "2.2.2.2"]
    assert rows["sysmon", "file_deleted"]["host"]["name"] == "pc1"
    assert rows["wmi", "wmi_provider_start"]["event"]["provider"] == "cimwin32"
    assert rows["wmi", "wmi_provider_start"]["process"]["pid"] == 12
    task = rows["security", "scheduled_task_created"]
    assert task["process"]["command_line"] == "c:\\x\\run.exe -a b"
    assert task["winlog"]["extra"]["task_name"] == "bad"
    process = rows["processes", "process_snapshot"]["process"]
    assert process["command_line"] == "dir" and process["start"] is None and process["hash_sha256"] is None
    assert process["parent"]["pid"] is None
    assert rows["network", "tcp_established"]["source"]["port"] == 4444
    error = rows["web_logs", "apache_error_log"]
    assert error["source"]["ip"] == "::1" and error["source"]["port"] == 55
    access = rows["web_logs", "apache_access_log"]
    assert str(access["timestamp"]) == "2024-01-01 10:00:00"
    services = events.where("registry.path like '%services'").first()
    assert services["process"]["executable"] == "s.exe" and services["process"]["args"] == ["-k", "x"]


def test_storage_and_detection(spark, events, tmp_path):
    tables.write_events(events, str(tmp_path))
    stored = tables.read_events(spark, str(tmp_path))
    rules = RuleSet.of(
        "WIN_USER_CREATED_001", "WIN_GROUP_ADD_001", "WIN_REMOTE_LOGIN_001", "WIN_SENSITIVE_FILE_DELETE_001",
        "TASK_WEBROOT_EXEC_001", "REG_RUNKEY_001", "NET_SUSPICIOUS_PORT_001", "WEB_LFI_001", "WIN_SCHTASK_CREATED_001",
        "WEB_SCANNER_UA_001",
    )
    tables.write_findings(detect(stored, rules), str(tmp_path))
    found = tables.read_findings(spark, str(tmp_path))
    got = {r["rule_id"] for r in found.findings.collect()}
    assert got == {
        "WIN_USER_CREATED_001", "WIN_GROUP_ADD_001", "WIN_REMOTE_LOGIN_001", "WIN_SENSITIVE_FILE_DELETE_001",
        "TASK_WEBROOT_EXEC_001", "REG_RUNKEY_001", "NET_SUSPICIOUS_PORT_001", "WEB_LFI_001", "WIN_SCHTASK_CREATED_001",
        "WEB_SCANNER_UA_001",
    }
    assert found.triggers.count() == len(got)
    only = detect(stored, rules, channels=["sysmon"]).findings.collect()
    assert [r["rule_id"] for r in only] == ["WIN_SENSITIVE_FILE_DELETE_001"]


def test_unparsed_and_hashes(collections):
    dropped = unparsed(src.event_log(collections, "security"), "security").collect()
    assert [(r["event_id"], r["dropped"]) for r in dropped] == [(9999, 1)]
    hashes = {r["module"]: r["declared"] for r in src.module_hashes(collections).collect()}
    assert len(hashes) == 6 and hashes["registry"] == "ab" and hashes["network"] is None


def test_reassembly_does_not_depend_on_block_size(collections):
    entries = src.web_entries(collections).where("log_name like '%error%'")
    chunks = cut_lineage(dump_chunks(entries))
    results = []
    for size in (3, 1000):
        rows = reassemble(chunks, size).orderBy("client").collect()
        results.append([(r["client"], r["method"], r["path"], r["body"]) for r in rows])
    assert results[0] == results[1]
    # The body is cut at the declared length; the last request never completes.
    assert results[0] == [("10.0.0.8:2", "GET", "/a", ""), ("10.0.0.9:1", "POST", "/up.php", "cmd=aGET x")]


def test_request_addresses_from_access_log(spark):
    access = spark.createDataFrame(
        [("c", 1, "1.1.1.1", "01/Jan/2024:10:00:03 +0000", "GET", "/a", 200, 1, "-", "x"),
         ("c", 2, "2.2.2.2", "01/Jan/2024:10:00:01 +0000", "GET", "/b", 200, 1, "PHPSESSID=zz", "x")],
        "collection_id string, ord bigint, client_ip string, timestamp string, method string, path string, "
        "status_code int, bytes bigint, referer string, user_agent string",
    )
    stamp = "timestamp'2024-01-01 10:00:00'"
    requests = spark.createDataFrame(
        [("c", 10, "", "GET", "/a", "x"), ("c", 11, "", "GET", "/q", "Cookie: PHPSESSID=zz"), ("c", 12, "", "GET", "/n", "x"),
         ("c", 13, "9.9.9.9:1", "GET", "/a", "x")],
        "collection_id string, ord bigint, client string, method string, path string, raw string",
    ).withColumns({"time_start": F.expr(stamp), "time_end": F.expr(stamp), "body": F.lit("")})
    matched = match_request_ips(normalize_requests(requests), normalize_access(access))
    got = {r["ord"]: (r["source"]["ip"], r["match_method"]) for r in matched.collect()}
    assert got == {
        10: ("1.1.1.1", "path_fallback"), 11: ("2.2.2.2", "session"), 12: (None, "unmatched"), 13: ("9.9.9.9", None)
    }
    stats = {r["match_method"]: r["n"] for r in match_stats(matched).collect()}
    assert stats == {"path_fallback": 1, "session": 1, "unmatched": 1}


def test_log_text_and_integrity(spark, tmp_path):
    (tmp_path / "access.log").write_text(
        '1.2.3.4 - - [10/Mar/2025:14:32:01 +0200] "GET /x HTTP/1.1" 404 - "-" "nmap"\nbroken line\n'
    )
    (tmp_path / "error.log").write_text(
        "[Mon Mar 10 14:32:01.123456 2025] [core:error] [pid 1] [client 1.2.3.4:99] message here\n"
        "[Mon Mar 10 14:32:01.123456 2025] [core:error] [pid 1] other\n"
    )
    row = read_access_log(spark, str(tmp_path / "access.log")).collect()
    assert [(r["client_ip"], r["status_code"], r["bytes"]) for r in row] == [("1.2.3.4", 404, None)]
    errors = read_error_log(spark, str(tmp_path / "error.log")).collect()
    assert [r["client"] for r in errors] == ["1.2.3.4:99", None]
    good = hashlib.sha256((tmp_path / "access.log").read_bytes()).hexdigest().upper()
    manifest = spark.createDataFrame([("access.log", good), ("error.log", "00")], "file_name string, declared string")
    got = {r["file_name"]: r["accepted"] for r in verify_integrity(spark, str(tmp_path), manifest).collect()}
    assert got == {"access.log": True, "error.log": False}


def test_large_files_are_hashed_by_segments(spark, tmp_path):
    import gzip
    import random

    made = random.Random(3)
    files = {
        "noise.bin": made.randbytes(40_000),
        "blanks.bin": bytes(made.choice(b" \x00\xff\n\r}") for _ in range(20_000)),
        "ends with a blank.log": b"some words " * 1_500,
        "ends in lines.log": b" " + b"a line of a log\r\n" * 700,
        "marked.txt": b"\xef\xbb\xbf" + "Gr\u00fc\u00dfe an alle ".encode() * 700,
        "marked-2.txt": b"\xef\xbb\xbf" + b"no blank at the end" * 700,
        "only blanks": b" " * 9_000,
        "no blank": b"x" * 9_000,
        "zeros{1}.bin": bytes(30_000),
        "edge.bin": made.randbytes(4_096),
        "small.bin": made.randbytes(4_095) + b" ",
        "one.bin": b" ",
        "empty.bin": b"",
        "packed.log.GZ": gzip.compress(made.randbytes(9_000)),
        "packed.log.gz": gzip.compress(made.randbytes(9_000)),
    }
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    # Spark's readers leave out empty files.
    expected = sorted((name, hashlib.sha256(data).hexdigest(), len(data)) for name, data in files.items() if data)
    split, limit = "spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength"
    before = {name: spark.conf.get(name) for name in (split, limit)}
    try:
        # No value may be larger, the packed files apart.
        spark.conf.set(limit, str(max(len(files["packed.log.gz"]), len(files["packed.log.GZ"]))))
        for size, segment in [(701, 4_096), (5_000, 4_096), (1_000_000, 9_000), (997, 2_000)]:
            spark.conf.set(split, str(size))
            got = sorted(map(tuple, file_hashes(spark, str(tmp_path / "in"), segment).collect()))
            assert got == expected, (size, segment)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_streamed_row_rules_equal_batch(spark, events, tmp_path):
    from casegraph.streaming.streams import stream_row_findings

    events.where("channel = 'security'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = (
        stream_row_findings(stream).select("id", "rule_id").writeStream.format("memory").queryName("rows")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = detect(spark.read.parquet(str(tmp_path / "in")), RuleSet(RuleSet.default().row_rules, {})).findings
    key = lambda r: (r["id"], r["rule_id"])
    assert sorted(map(key, spark.table("rows").collect())) == sorted(map(key, batch.collect()))


def stopped_after(query, rows):
    """Stop a stream once it has read so many rows and run one batch more; timers keep it going by itself."""
    for _ in range(600):
        done = [p["numInputRows"] for p in query.recentProgress]
        if sum(done) >= rows and done[-1] == 0:
            break
        time.sleep(0.1)
    query.stop()
    assert sum(done) >= rows


def test_streamed_requests_equal_batch(spark, collections, tmp_path):
    from casegraph.streaming.streams import stream_requests

    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    entries = src.web_entries(collections).where("log_name like '%error%'")
    chunks = cut_lineage(dump_chunks(entries))
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    query = (
        stream_requests(stream).writeStream.format("memory").queryName("requests").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    stopped_after(query, chunks.count())
    got = sorted((r["client"], r["raw"]) for r in spark.table("requests").collect())
    want = sorted((r["client"], r["raw"]) for r in reassemble(chunks).collect())
    assert got == want and len(got) == 2


def _streamed(spark, tmp_path, name, batches, idle_ms):
    """Rows of a stream that gets one file after the other, each in a run of its own."""
    from casegraph.streaming.streams import stream_requests

    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = "collection_id string, client string, ord bigint, time timestamp, chunk string"
    for rows in batches:
        df = spark.createDataFrame(rows, "collection_id string, client string, ord bigint, t long, chunk string")
        df = df.withColumn("time", F.timestamp_seconds("t")).drop("t").select("collection_id", "client", "ord", "time", "chunk")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            stream_requests(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle_ms)
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).start()
        )
        stopped_after(query, len(rows))
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("client", "raw", "complete").collect())


HEAD = "POST /b HTTP/1.1\r\nContent-Length: 6\r\n\r\n"


def test_stream_keeps_all_chunks_of_an_active_connection(spark, tmp_path):
    batches = [[("c", "a", 1, 1, HEAD)], [("c", "a", 2, 2, "abc")], [("c", "a", 3, 3, "def")]]
    assert _streamed(spark, tmp_path, "active", batches, 3_600_000) == [("a", HEAD + "abcdef", True)]


def test_stream_gives_unfinished_requests_of_silent_connections(spark, tmp_path):
    batches = [[("c", "a", 1, 1, HEAD), ("c", "a", 2, 2, "abc")], [("c", "b", 3, 3, HEAD + "123456")]]
    got = _streamed(spark, tmp_path, "silent", batches, 1)
    assert got == [("a", HEAD + "abc", False), ("b", HEAD + "123456", True)]


def test_whole_run(spark, tmp_path):
    """Graph, summary and rejected rows are stored and read back."""
    from casegraph.plans.investigate import run

    folder = tmp_path / "collections"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(DOCUMENT))
    rules = RuleSet.of("WIN_USER_CREATED_001", "WIN_GROUP_ADD_001", "WIN_REMOTE_LOGIN_001", "TASK_WEBROOT_EXEC_001")
    graph = run(spark, str(folder), str(tmp_path / "out"), rules)
    found = tables.read_findings(spark, str(tmp_path / "out")).findings
    assert graph.nodes.count() > 0 and graph.actors.count() > 0 and graph.node_events.count() > 0
    summary = tables.read_summary(spark, str(tmp_path / "out")).collect()
    assert [r["findings"] for r in summary] == [found.count()] and summary[0]["actors"] >= 1
    assert summary[0]["events"] == tables.read_events(spark, str(tmp_path / "out")).count()
    rejected = tables.read_quarantine(spark, str(tmp_path / "out"))
    assert "reasons" in rejected.columns


def test_faulty_rules_are_named(events):
    def faulty(view):
        raise RuntimeError("no")

    rules = RuleSet.of("WIN_USER_CREATED_001").register(("faulty", faulty))
    found = detect(events, rules)
    assert found.left_out == ("faulty",) and found.findings.count() == 1


def test_numbers_of_any_width(spark):
    from casegraph.functions.exprs import hex_to_int

    cases = {"0x1a2c": 6700, "0x0000000000001a2c": 6700, "0x0": 0, "0xffffffffffffffff": None, "0x7fffffffffffffff": 2**63 - 1,
             "00000000000000000000000a": 10, "0xzz": None, "": None, None: None, "AB": 171}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", hex_to_int(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_web_events_keep_request_text(collections):
    events = web_events(cut_lineage(src.web_entries(collections)))
    kinds = {r["event"]["dataset"] for r in events.select("event").collect()}
    assert kinds == {"apache.access", "apache.error", "apache.dumpio"}
