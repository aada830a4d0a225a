"""Streaming forms of the row rules and of request reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.functions.events import rule_view
from casegraph.operators.reassembly import make_stepper
from casegraph.plans.catalog import rule_catalog
from casegraph.plans.detect import _payload, row_hits, usable_rules
from casegraph.plans.rules_row import RowRule, default_row_rules


def stream_row_findings(events: DataFrame, rules: list[RowRule] | None = None) -> DataFrame:
    """Row-rule findings of a stream of normalised events: stateless, same rules as in batch.

    The logon id is the event's own; :func:`stream_logons` looks up that of the process.
    """
    view = rule_view(events)
    usable = usable_rules(view, rules or default_row_rules())
    hits = row_hits(view, [rule for rule, _ in usable])
    payload = None
    for at, (_, body) in enumerate(usable):
        test = F.col("rule_at") == at
        payload = F.when(test, body) if payload is None else payload.when(test, body)
    rows = hits.withColumn("_p", x.once(payload)).select("collection_id", "channel", "id", "created", "own_logon_id", "_p.*")
    catalog = F.broadcast(rule_catalog(events.sparkSession))
    return rows.join(catalog, "rule_id").select(
        "collection_id",
        "channel",
        x.stable_id(F.col("collection_id"), F.col("channel"), F.col("rule_id"), F.col("id")).alias("id"),
        F.col("id").alias("event_id"),
        F.col("created").alias("timestamp"),
        "rule_id",
        "rule_name",
        F.coalesce("own_severity", "severity").alias("severity"),
        F.coalesce("own_confidence", "confidence").alias("confidence"),
        "description",
        "extra",
        F.col("own_logon_id").alias("logon_id"),
    )


REQUEST_DDL = (
    "collection_id STRING, client STRING, time_start TIMESTAMP, time_end TIMESTAMP, raw STRING, complete BOOLEAN"
)


def stream_requests(chunks: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Requests from a stream of traffic chunks, emitted when they complete.

    ``chunks``: collection_id, client, ord, time, chunk.  One state and one timer per connection.
    Every input renews the timer; a connection silent for ``idle_ms`` gives its unfinished request
    as a row with ``complete`` false and is forgotten, so nothing is lost and nothing piles up.
    """
    processor = _request_processor(fv.DUMP_REQUEST_LINE, idle_ms)
    return chunks.groupBy("collection_id", "client").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=StructType.fromDDL(REQUEST_DDL),
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def _request_processor(request_line: str, idle_ms: int):
    """The stateful processor; nested so that it reaches the executors by value."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    make = make_stepper(request_line)
    columns = ["collection_id", "client", "time_start", "time_end", "raw", "complete"]

    class RequestProcessor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            # The open request's text arrives in chunks and is kept as a list, so adding one
            # does not rewrite what is there.
            self.state = handle.getValueState(
                "machine",
                "opened BIGINT, in_body BOOLEAN, line STRING, length BIGINT, received BIGINT, time_start TIMESTAMP, "
                "time_end TIMESTAMP",
            )
            self.parts = handle.getListState("parts", "chunk STRING")

        def handleInputRows(self, key, rows, timerValues):
            kept = self.state.get() if self.state.exists() else None
            machine = (None, False, "", 0, 0) if kept is None or kept[0] is None else tuple(kept[:5])
            started, ended = (None, None) if kept is None else kept[5:7]
            parts = []
            out = []
            for pdf in rows:
                for row in pdf.sort_values("ord").itertuples():
                    was_open = machine[0] is not None
                    machine, request, done = make(machine, int(row.ord), row.chunk)
                    if request is None:
                        continue
                    if not was_open:
                        started = row.time
                    parts.append((row.chunk,))
                    ended = row.time
                    if done:
                        earlier = [p[0] for p in self.parts.get()] if self.parts.exists() else []
                        self.parts.clear()
                        text = "".join(earlier + [p[0] for p in parts])
                        out.append((key[0], key[1], started, row.time, text, True))
                        parts, started = [], None
            if parts:
                self.parts.appendList(parts)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if machine[0] is None:
                self.state.clear()
            else:
                self.state.update((*machine, started, ended))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            if out:
                yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                kept = self.state.get()
                text = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
                self.parts.clear()
                self.state.clear()
                yield pd.DataFrame([(key[0], key[1], kept[5], kept[6], text, False)], columns=columns)

        def close(self):
            pass

    return RequestProcessor()


HELD_DDL = "collection_id STRING, channel STRING, event_id STRING, rule_id STRING, logon_id STRING"


def stream_logons(
    events: DataFrame, rules: list[RowRule] | None = None, delay: str = "10 minutes", hold_ms: int = 600_000, keep_ms: int = 86_400_000
) -> DataFrame:
    """``event_id, rule_id`` of the row-rule hits of a stream with the logon id that batch runs look up.

    Hits with an id of their own, or without a process, pass at once.  The others wait, keyed by process,
    until the watermark (``delay`` behind the latest event) is ``hold_ms`` past their event, so that a
    create event may come in a later micro-batch; of several the first in order counts, as in batch.  A
    process without events for ``keep_ms`` of event time is forgotten, so the state empties.
    """
    view = rule_view(events)
    usable = usable_rules(view, rules or default_row_rules())
    matched = F.array_compact(F.array(*[F.when(rule.when, F.lit(rule.rule_id)) for rule, _ in usable]))
    lacking = F.col("guid").isNotNull() & F.col("own_logon_id").isNull()
    creates = (F.col("code") == "1") & F.col("guid").isNotNull() & F.col("own_logon_id").isNotNull()
    rows = view.select(
        "collection_id", "channel", "guid", F.col("id").alias("event_id"), "ord", "own_logon_id",
        F.coalesce("event_time", "created").alias("at"), lacking.alias("lacking"), creates.alias("creates"), x.once(matched).alias("rule_ids"),
    )
    own = rows.where("NOT lacking").withColumn("rule_id", F.explode("rule_ids")).select(
        "collection_id", "channel", "event_id", "rule_id", F.col("own_logon_id").alias("logon_id")
    )
    keyed = rows.where(F.col("creates") | (F.col("lacking") & (F.size("rule_ids") > 0))).withColumn(
        "rule_ids", F.when(F.col("lacking"), F.col("rule_ids"))
    )
    held = keyed.withWatermark("at", delay).groupBy("collection_id", "channel", "guid").transformWithStateInPandas(
        statefulProcessor=_logon_processor(hold_ms, keep_ms),
        outputStructType=StructType.fromDDL(HELD_DDL),
        outputMode="Append",
        timeMode="EventTime",
    )
    return own.unionByName(held)


def _logon_processor(hold_ms: int, keep_ms: int):
    """The stateful processor; nested so that it reaches the executors by value."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    columns = ["collection_id", "channel", "event_id", "rule_id", "logon_id"]

    class LogonProcessor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.first = handle.getValueState("first", "ord BIGINT, logon STRING")
            self.last = handle.getValueState("last", "at BIGINT")
            self.hits = handle.getListState("hits", "event_id STRING, rule_id STRING, due BIGINT")

        def handleInputRows(self, key, rows, timerValues):
            first = tuple(self.first.get()) if self.first.exists() else None
            last = self.last.get()[0] if self.last.exists() else 0
            hits = []
            for pdf in rows:
                for row in pdf.itertuples():
                    at = int(row.at.timestamp() * 1000)
                    last = max(last, at)
                    if row.creates and (first is None or (int(row.ord), row.own_logon_id) < first):
                        first = int(row.ord), row.own_logon_id
                    if row.rule_ids is not None:
                        hits += [(row.event_id, rule, at + hold_ms) for rule in row.rule_ids]
            if first:
                self.first.update(first)
            self.last.update((last,))
            if hits:
                self.hits.appendList(hits)
            for due in {h[2] for h in hits} | {last + keep_ms}:
                self.handle.registerTimer(due)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs()
            waiting = [tuple(h) for h in self.hits.get()] if self.hits.exists() else []
            ready = [h for h in waiting if h[2] <= now]
            if ready:
                left = [h for h in waiting if h[2] > now]
                self.hits.clear()
                if left:
                    self.hits.appendList(left)
                logon = self.first.get()[1] if self.first.exists() else None
                yield pd.DataFrame([(*key[:2], h[0], h[1], logon) for h in ready], columns=columns)
            if self.last.exists() and self.last.get()[0] + keep_ms <= now:
                self.first.clear()
                self.last.clear()

        def close(self):
            pass

    return LogonProcessor()
