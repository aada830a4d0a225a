"""Logon ids on a stream of shuffled micro-batches against the batch lookup."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casegraph.plans.detect import RuleSet, detect
from casegraph.plans.normalize_windows import normalize_log
from casegraph.session import cut_lineage
from casegraph.streaming.streams import stream_logons

RAW = "collection_id string, ord bigint, time_created string, event_id int, message string, event_data map<string,string>"


def raw_rows():
    """Create events of processes, deletions with and without an id of their own, and processes nobody saw start."""
    rng = random.Random(4)
    start, rows = datetime(2024, 1, 1), []

    def row(event_id, seconds, **data):
        time = (start + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
        rows.append(("h", len(rows), time, event_id, "m", {k: v for k, v in data.items() if v}))

    for k in range(40):
        at = k * 20
        if k % 5:
            row(1, at, ProcessGuid=f"{{P{k}}}", LogonId=f"0x{k + 1:x}", Image="C:\\a.exe")
        if k % 7 == 0:
            row(1, at + 2, ProcessGuid=f"{{P{k}}}", LogonId="0xfff", Image="C:\\a.exe")
        for n in range(rng.randrange(4)):
            own = f"0x{500 + k:x}" if rng.random() < 0.3 else None
            row(26, at + rng.randrange(1, 200), ProcessGuid=f"{{P{k}}}", LogonId=own, TargetFilename=f"C:\\data\\{k}-{n}.sql")
        row(26, at, TargetFilename=f"C:\\data\\none{k}.sql")
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = raw_rows()
    events = cut_lineage(normalize_log(spark.createDataFrame(rows, RAW), "sysmon"))
    rules = RuleSet.of("WIN_SENSITIVE_FILE_DELETE_001", "SYS_SUSPICIOUS_FILE_DROP_001")
    batch = detect(events, rules)
    want = sorted(
        (r["event_id"], r["rule_id"], str(r["logon_id"]))
        for r in batch.findings.join(batch.triggers.select(F.col("finding_id").alias("id"), "event_id"), "id").collect()
    )
    assert len({w[2] for w in want}) > 10 and any(w[2] == "None" for w in want)
    # Files in a shuffled order within the delay, and two that only move the watermark on.
    order = list(range(len(rows)))
    random.Random(2).shuffle(order)
    parts = [order[k::6] for k in range(6)]
    late = [("h", 10_000 + d, f"2024-01-{10 + d:02d}T00:00:00Z", 1, "m", {"ProcessGuid": "{END}", "LogonId": "0x1"}) for d in range(3)]
    folder = tmp_path / "in"
    for k, part in enumerate(parts):
        ids = [rows[i][1] for i in part]
        events.where(F.col("ord").isin(ids)).coalesce(1).write.mode("append").parquet(str(folder))
    for one in late:
        normalize_log(spark.createDataFrame([one], RAW), "sysmon").coalesce(1).write.mode("append").parquet(str(folder))
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = (
        stream_logons(stream, rules.row_rules, delay="1 hour").writeStream.format("memory").queryName("logons").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    got = sorted((r["event_id"], r["rule_id"], str(r["logon_id"])) for r in spark.table("logons").collect())
    assert got == want
    # Nothing but the last processes is left in the state.
    state = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert state and state[-1]["numRowsTotal"] <= 12
