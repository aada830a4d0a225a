"""Media columns: Matroska bytes to packet and cue tables, and texts stored as 8-bit samples.

``packet_table`` and ``cue_table`` take any binary column.  The registered query stores every text
as the samples of a container, parses the stored bytes and computes its digest from the packets.

Defined results: null media, empty bytes and bytes that are no container give no packet; a container
whose tail is torn off gives the frames of its whole blocks; a null text counts as empty (a payload of
64 zero bytes); equal texts give equal values; repeated rows stay; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casegraph.llm.common import bounded_batches, table, texts_of
from casegraph.llm.matroska import Container, Malformed, parse, payload, write_samples

UNIT = 64
#: Rows of one output batch of the packet table.
_ROWS = 20_000


def _parsed(data: bytes | None) -> Container | None:
    try:
        return parse(data) if data else None
    except (Malformed, IndexError, OverflowError):
        return None


def _exploded(df: DataFrame, media: str, key: str, fields: str, rows_of) -> DataFrame:
    """One row for each item that ``rows_of(container)`` lists, after the row's key."""
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = ["key", *(f.split()[0] for f in fields.split(", "))]
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in fields.split(", ")]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []

            def full(keys=keys, rows=rows, batch=batch) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), *arrays], names)
                keys.clear()
                rows.clear()
                return out

            for i, data in enumerate(batch.column("media")):
                if found := _parsed(data.as_py()):
                    for row in rows_of(found):
                        keys.append(i)
                        rows.append(row)
                        if len(rows) >= _ROWS:
                            yield full()
            yield full()

    out = df.select(df[key].alias("key"), df[media].alias("media")).mapInArrow(listed, f"key {kind}, {fields}")
    return out.withColumnRenamed("key", key)


def packet_table(df: DataFrame, media: str, key: str) -> DataFrame:
    """One row for each frame: its track, time stamp, place in the bytes, and how it was laced."""
    return _exploded(
        df, media, key,
        "track long, cluster int, block int, frame int, timestamp_ns long, duration_ns long, keyframe boolean, "
        "lacing string, start long, length long, codec string",
        lambda c: [
            (p.track, p.cluster, p.block, p.frame, p.timestamp_ns, p.duration_ns, p.keyframe, p.lacing, p.start,
             p.length, c.tracks.get(p.track, {}).get("codec"))
            for p in c.packets
        ],
    )


def cue_table(df: DataFrame, media: str, key: str) -> DataFrame:
    """One row for each seek point: its time stamp, track, and the byte position of its cluster."""
    return _exploded(df, media, key, "timestamp_ns long, track long, position long", lambda c: c.cues)


def sample_payload(text: str) -> bytes:
    """The text's bytes with zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "replace")
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def features(found: Container) -> str:
    """What the packets and cues of a container show, as one line."""
    laces = Counter(p.lacing for p in found.packets)
    sound = all(position in found.clusters for _, _, position in found.cues)
    return (
        f"tracks={len(found.tracks)};clusters={len(found.clusters)};cues={len(found.cues)};cues_sound={int(sound)};"
        f"packets={len(found.packets)};lacing={','.join(f'{k}:{laces[k]}' for k in sorted(laces))};"
        f"duration_us={round(found.duration_ns / 1000)};last_us={max(p.timestamp_ns for p in found.packets) // 1000};"
        f"longest={max(p.length for p in found.packets)}"
    )


def stored_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digest of every text after a round trip through a container."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_ in texts_of(batch, "text"):
                media = write_samples(sample_payload(text_))
                found = parse(media)
                back = payload(media, found)
                rows.append(
                    (
                        len(text_.encode("utf-8", "replace")), len(back), hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(found),
                    )
                )
            whole, word = pa.int64(), pa.string()
            kinds = [whole, whole, word, whole, whole, word, word]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        digested,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
