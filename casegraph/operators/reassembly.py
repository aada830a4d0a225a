"""Putting requests together from dumped traffic chunks.

Chunks of one connection form a sequence that a small state machine cuts into requests: a
request line opens one, a blank line ends its headers, and it is complete when the body holds
as many bytes as its content-length says.  A connection may be long, so its chunks are cut into
blocks that run in parallel.  Every block first assumes that nothing is open when it starts;
blocks whose predecessor really left something open run again with that small state, until no
block's start changes.  The state never holds bodies, only counters and an unfinished header line.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.session import cut_lineage

c = F.col

STATE_DDL = (
    "opened BIGINT, in_body BOOLEAN, line STRING, length BIGINT, received BIGINT"
)


def dump_chunks(entries: DataFrame) -> DataFrame:
    """Chunks of dumped traffic among error-log entries, unescaped, with their client.

    ``entries``: collection_id, ord, timestamp, level, client, message.
    """
    message = F.coalesce(c("message"), F.lit(""))
    is_dump = message.contains("mod_dumpio:") | F.coalesce(c("level"), F.lit("")).contains("dumpio")
    payload = x.group(message, fv.DUMP_PAYLOAD, flags="d")
    named = F.regexp_extract(message, fv.DUMP_CLIENT, 1)
    client = F.coalesce(
        x.non_empty(c("client")),
        F.when(named != "", F.concat_ws(":", named, F.regexp_extract(message, fv.DUMP_CLIENT, 2))),
    )
    return (
        entries.where(is_dump)
        .select(
            "collection_id", "ord", x.error_time(c("timestamp")).alias("time"), client.alias("client"),
            payload.alias("payload"),
        )
        .where(c("payload").isNotNull() & ~c("payload").rlike(fv.DUMP_SIZE_ONLY) & c("client").isNotNull())
        .select("collection_id", "client", "ord", "time", unescape(c("payload")).alias("chunk"))
    )


def unescape(text: Column) -> Column:
    """Escapes are replaced one kind after the other, backslash pairs first."""
    for escaped, plain in (("\\\\", "\\"), ("\\r", "\r"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def is_dump_entry() -> Column:
    message = F.coalesce(c("message"), F.lit(""))
    return message.contains("mod_dumpio:") | F.coalesce(c("level"), F.lit("")).contains("dumpio")


def make_stepper(request_line: str):
    """The state machine over one chunk: ``step(state, ord, chunk) -> (state, request, done)``.

    ``request`` is the ord of the chunk that opened the request this chunk belongs to, or None
    for an orphan.  Nested so that it reaches the executors by value.
    """
    import re

    opening = re.compile(request_line)

    def step(state, ord_, chunk):
        opened, in_body, line, length, received = state
        if opened is None:
            if not opening.match(chunk):
                return state, None, False
            opened, in_body, line, length, received = ord_, False, "", 0, 0
        if in_body:
            received += len(chunk.encode("utf-8", errors="ignore"))
        else:
            head, end, rest = (line + chunk).partition("\r\n\r\n")
            lines = head.split("\r\n")
            # Without the blank line the last part is unfinished and waits for more text.
            keep = "" if end else lines.pop()
            for header in lines:
                name, colon, value = header.partition(":")
                if colon and name.strip().lower() == "content-length":
                    digits = value.strip()
                    length = int(digits) if digits.isdigit() else 0
            if end:
                in_body, line = True, ""
                received = len(rest.encode("utf-8", errors="ignore"))
            else:
                # The blank line may come in parts: keep the line break before it as well.
                line = "\r\n" + keep if lines and keep in ("", "\r") else keep
        done = in_body and (not length or received >= length)
        request = opened
        if done:
            return (None, False, "", 0, 0), request, True
        return (opened, in_body, line, length, received), request, False

    return step


def _runner(request_line: str, per_chunk: bool):
    """Group function: run the machine over one block from its start state."""
    step = make_stepper(request_line)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        first = pdf.iloc[0]
        opened = None if pd.isna(first["opened"]) else int(first["opened"])
        state = (
            opened,
            bool(first["in_body"]) if opened is not None else False,
            (first["line"] or "") if opened is not None else "",
            int(first["length"]) if opened is not None else 0,
            int(first["received"]) if opened is not None else 0,
        )
        requests, finished = [], []
        for ord_, chunk in zip(pdf["ord"], pdf["chunk"], strict=True):
            state, request, done = step(state, int(ord_), chunk)
            requests.append(request)
            finished.append(done)
        if per_chunk:
            return pd.DataFrame(
                {
                    "collection_id": pdf["collection_id"],
                    "client": pdf["client"],
                    "ord": pdf["ord"],
                    "request": pd.array(requests, dtype="Int64"),
                    "done": finished,
                }
            )
        return pd.DataFrame(
            {
                "collection_id": [first["collection_id"]],
                "client": [first["client"]],
                "block": [first["block"]],
                "opened": pd.array([state[0]], dtype="Int64"),
                "in_body": [state[1]],
                "line": [state[2]],
                "length": [state[3]],
                "received": [state[4]],
            }
        )

    return run


def _same_state(a: str, b: str) -> Column:
    names = ["opened", "in_body", "line", "length", "received"]
    return ~x.any_of([~c(f"{a}.{n}").eqNullSafe(c(f"{b}.{n}")) for n in names])


def _replace_rows(old: DataFrame, new: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    fresh = new.select(*keys, F.struct(*names).alias("_new"))
    return old.join(fresh, keys, "left").select(
        *keys,
        *[F.when(c("_new").isNotNull(), c(f"_new.{n}")).otherwise(c(n)).alias(n) for n in names],
    )


def assign_requests(chunks: DataFrame, block_size: int = 20000) -> DataFrame:
    """``(collection_id, client, ord, request, done)``: the request each chunk belongs to."""
    keys = ["collection_id", "client", "block"]
    blocks = cut_lineage(chunks.withColumn("block", F.floor(c("ord") / block_size).cast("bigint")))
    idle = [
        F.lit(None).cast("bigint").alias("opened"),
        F.lit(False).alias("in_body"),
        F.lit("").alias("line"),
        F.lit(0).cast("bigint").alias("length"),
        F.lit(0).cast("bigint").alias("received"),
    ]
    state_names = ["opened", "in_body", "line", "length", "received"]
    end_ddl = f"collection_id STRING, client STRING, block BIGINT, {STATE_DDL}"

    def run_blocks(starts: DataFrame) -> DataFrame:
        return (
            blocks.join(starts, keys)
            .groupBy(*keys)
            .applyInPandas(_runner(fv.DUMP_REQUEST_LINE, per_chunk=False), end_ddl)
        )

    starts = cut_lineage(blocks.select(*keys).distinct().select(*keys, *idle))
    ends = cut_lineage(run_blocks(starts))
    order = W.partitionBy("collection_id", "client").orderBy("block")
    while True:
        # One small row per block: what each block should have started with.
        due = ends.select(
            *keys, *[F.lag(n).over(order).alias(n) for n in state_names]
        ).select(
            *keys,
            "opened",
            F.coalesce("in_body", F.lit(False)).alias("in_body"),
            F.coalesce("line", F.lit("")).alias("line"),
            F.coalesce("length", F.lit(0)).cast("bigint").alias("length"),
            F.coalesce("received", F.lit(0)).cast("bigint").alias("received"),
        )
        compared = due.alias("n").join(starts.alias("o"), keys)
        changed = cut_lineage(
            compared.where(~_same_state("n", "o")).select(*keys, *[c(f"n.{s}").alias(s) for s in state_names])
        )
        if changed.isEmpty():
            break
        starts = cut_lineage(_replace_rows(starts, changed, keys, state_names))
        ends = cut_lineage(_replace_rows(ends, run_blocks(changed), keys, state_names))
    return (
        blocks.join(starts, keys)
        .groupBy(*keys)
        .applyInPandas(
            _runner(fv.DUMP_REQUEST_LINE, per_chunk=True),
            "collection_id STRING, client STRING, ord BIGINT, request BIGINT, done BOOLEAN",
        )
    )


def reassemble(chunks: DataFrame, block_size: int = 20000) -> DataFrame:
    """Completed requests: client, times, method, path, headers-free body and raw text.

    Each request is one output row, so only its own chunks are collected.
    """
    placed = cut_lineage(assign_requests(chunks, block_size).where(c("request").isNotNull()))
    keys = ["collection_id", "client", "request"]
    complete = placed.where("done").select(*keys)
    parts = placed.join(complete, keys, "left_semi").join(chunks, ["collection_id", "client", "ord"])
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "time", "chunk"))), lambda e: e["chunk"]
        ),
        "",
    )
    requests = parts.groupBy(*keys).agg(
        text.alias("raw"),
        F.min(F.struct("ord", "time"))["time"].alias("time_start"),
        F.max(F.struct("ord", "time"))["time"].alias("time_end"),
        F.max("ord").alias("ord"),
    )
    head = F.substring_index("raw", "\r\n\r\n", 1)
    rest = F.expr("substring(raw, length(substring_index(raw, '\\r\\n\\r\\n', 1)) + 5)")
    words = F.split(F.substring_index(head, "\r\n", 1), " ")
    well_formed = F.size(words) == 3
    # The last content-length header counts; bytes are compared but characters are kept.
    lengths = F.regexp_extract_all(head, F.lit(r"(?i)\r\n[ \t]*content-length[ \t]*:[ \t]*(\d*)"), F.lit(1))
    length = F.coalesce(F.element_at(F.when(F.size(lengths) > 0, lengths), -1).try_cast("bigint"), F.lit(0))
    return requests.select(
        "collection_id",
        "ord",
        "client",
        "time_start",
        "time_end",
        F.when(well_formed, words[0]).alias("method"),
        F.when(well_formed, words[1]).alias("path"),
        F.when(well_formed, words[2]).alias("http_version"),
        F.when(length > 0, F.substring(rest, F.lit(1), length.cast("int"))).otherwise(rest).alias("body"),
        "raw",
    )


__all__ = ["assign_requests", "dump_chunks", "make_stepper", "reassemble"]
