"""Hand-made findings and events for the fusion and correlation tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casegraph.functions.events import build_events
from casegraph.plans.detect import Findings, conform, conform_triggers

T0 = datetime(2024, 5, 1, 12, 0, 0)


def at(minutes: float):
    return T0 + timedelta(minutes=minutes)


def finding(fid, no, rule="R", severity="high", confidence=0.8, keys=(), requires=(), provides=(), t=0.0,
            extra=None, tags=("t",), count=1, ip=None, guid=None, pid=None, parent_guid=None, parent_pid=None,
            name=None, collection="c1"):
    """One row of the finding schema, most members defaulted."""
    time = None if t is None else at(t)
    return (
        collection, "sysmon", fid, ("sysmon", 0, no, 0), time, rule, name or f"Name {rule}", "per_event",
        [tuple(x) for x in requires], [tuple(x) for x in provides], [list(k) for k in keys], severity, confidence,
        "T1", "tech", "execution", "exploitation", list(tags), "src", f"finding {fid}", count, extra or {}, {},
        (extra or {}).get("logon_id"), False, (time, ip, guid, pid, parent_guid, parent_pid, "proc", "user"),
    )


def cap(name, bind, *values):
    return (name, [bind], list(values))


def findings(spark, rows, triggers=None):
    from casegraph.schemas import FINDING_DDL, TRIGGER_DDL

    df = spark.createDataFrame(rows, FINDING_DDL)
    if triggers is None:
        triggers = [(r[0], r[1], r[2], f"e-{r[2]}", 0, None) for r in rows]
    tr = spark.createDataFrame(triggers, TRIGGER_DDL)
    return Findings(conform(df), conform_triggers(tr))


def events(spark, rows):
    """Events from (channel, ord, {dotted path: value}) rows."""
    out = None
    for channel, ord_, values in rows:
        raw = spark.createDataFrame([("c1", ord_)], "collection_id string, ord bigint")
        parser = {
            path: F.lit(value) if not isinstance(value, (list, dict)) else _literal(value)
            for path, value in values.items()
        }
        one = build_events(raw, channel, [(None, parser)], F.lit(str(ord_))).withColumn(
            "id", F.lit(f"{channel}-{ord_}")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _literal(value):
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    return F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
