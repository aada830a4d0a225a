"""Payload integrity: files against their declared SHA-256.

A file of up to ``SEGMENT`` bytes is one value.  SHA-256 takes the blocks of a file one after the other, but what it
carries from block to block is a state of about a hundred bytes.  So a larger file is read by byte ranges, by many
tasks, and stored in pieces.  Then round after round a task takes the next segment of a file and the state in which
the round before left it: no task reads more than a segment or a byte range, however large the file is.

Defined results: Spark's readers leave out empty files.  A larger file whose name ends like that of a compressed one
is still one value, as Spark's text reader would unpack it; so is every file where Python's ``hashlib`` has no
OpenSSL below it, which alone gives its state away.  A value has at most 2 GB.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.session import ensure_checkpoint_dir, release

c = F.col

#: Bytes that a task hashes in a round; smaller files are one value.
SEGMENT = 128 << 20
#: Bytes of a stored piece.
PIECE = 512 << 10
#: Byte ranges end at blanks, which texts of all kinds and packed bytes have; more than 2 GB without one is an error.
MARK = b" "
#: The text reader leaves this out at the beginning of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
#: Names of files that the text reader unpacks.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|lzo|lzo_deflate|zst|zstd|xz|passthrough)$"


# ------------------------------------------------------------------ states
class _State(ctypes.Structure):
    """OpenSSL's ``SHA256_CTX``."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8),
        ("bits", ctypes.c_uint32 * 2),
        ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint32),
        ("md_len", ctypes.c_uint32),
    ]


@cache
def _library() -> ctypes.CDLL | None:
    """The library below ``hashlib``, if it hashes on from a state as it should."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        text = bytes(range(200))
        state = _advance(library, _advance(library, None, [text[:77]]), [text[77:]])
        return library if _digest(library, state) == hashlib.sha256(text).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


def _advance(library: ctypes.CDLL, state: bytes | None, parts: Iterator[bytes] | list[bytes]) -> bytes:
    """The state after ``parts``; ``None`` is the state before the first byte."""
    context = _State() if state is None else _State.from_buffer_copy(state)
    if state is None:
        library.SHA256_Init(ctypes.byref(context))
    for part in parts:
        library.SHA256_Update(ctypes.byref(context), part, len(part))
    return bytes(context)


def _digest(library: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    library.SHA256_Final(out, ctypes.byref(_State.from_buffer_copy(state)))
    return out.raw.hex()


# ------------------------------------------------------------------ large files
def _pieces(batches: Iterator[pa.RecordBatch], files: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """``file, block, seq, size, data``: the bytes of each range in order, but the mark the file may end with.

    Each value begins with the mark before it, so the values of a batch are the file's bytes one after another.
    """
    at, seq, parts, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        data = b"".join(parts)
        values = ([files[at[0]]], [at[1]], [seq], [len(data)], [data])
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["file", "block", "seq", "size", "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        values = batch.column("value")
        _, offsets, data = values.buffers()
        width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
        edges = np.frombuffer(offsets, width)[values.offset : values.offset + len(values) + 1]
        changes = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        starts = [0, *changes.tolist()]
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            first, last = int(edges[start]), int(edges[end])
            if (keys[start], blocks[start]) != at:
                if parts:
                    yield row()
                at, seq, parts, size = (keys[start], blocks[start]), 0, [], 0
                first += len(MARK) if at[1] == 0 else 0
            while first < last:
                step = min(last - first, PIECE - size)
                parts.append(data[first : first + step].to_pybytes())
                first, size = first + step, size + step
                if size == PIECE:
                    yield row()
                    seq, parts, size = seq + 1, [], 0
    if parts:
        yield row()


def _hashed_on(batches: Iterator[pa.RecordBatch], states: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """``file, state`` after one segment of one file, whose pieces come in order."""
    file, state = None, None
    for batch in batches:
        if batch.num_rows and file is None:
            file = batch.column("file")[0].as_py()
            state = states[file]
        state = _advance(_library(), state, (part.as_py() for part in batch.column("data")))
    if file is not None:
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([state])], ["file", "state"])


def _round(pieces: DataFrame, states: dict[int, bytes], n_files: int) -> list[tuple[int, bytes]]:
    """The states after the pieces of one segment; each file has a task of its own."""
    dealt = pieces.select("file", "block", "seq", "data").repartitionById(n_files, c("file"))
    after = dealt.sortWithinPartitions("block", "seq").mapInArrow(partial(_hashed_on, states=states), "file int, state binary")
    return [(r["file"], bytes(r["state"])) for r in after.collect()]


def _beginning_and_end(path: str, length: int, read: int) -> tuple[bytes, bytes]:
    """What the text reader left out of a file; the number of bytes tells."""
    for beginning in (b"", BYTE_ORDER_MARK):
        for end in (b"", MARK):
            if length == len(beginning) + read + len(end):
                return beginning, end
    raise ValueError(f"{path}: {read} of {length} bytes were read")


def _large_hashes(spark: SparkSession, path: str, large: Callable[[DataFrame], DataFrame], segment: int) -> list[tuple]:
    """``file_name, actual, size_bytes`` of the large files."""
    key = F.xxhash64("_metadata.file_path").alias("key")
    listed = large(spark.read.format("binaryFile").load(path)).select(key, "path", "length").collect()
    if not listed:
        return []
    files = {r["key"]: number for number, r in enumerate(listed)}
    if len(files) < len(listed):
        raise ValueError("two of the large files have names of the same hash")
    values = large(spark.read.option("lineSep", MARK.decode()).text(path)).select(
        key, c("_metadata.file_block_start").alias("block"), F.concat(F.lit(MARK), c("value").cast("binary")).alias("value")
    )
    ddl = "file int, block long, seq int, size long, data binary"
    pieces = values.mapInArrow(partial(_pieces, files=files), ddl)
    ensure_checkpoint_dir(spark)
    table = f"{spark.sparkContext.getCheckpointDir()}/pieces-{uuid.uuid4().hex}"
    pieces.withColumn("segment", F.floor(c("block") / segment)).write.partitionBy("segment").parquet(table)
    stored = spark.read.schema(f"{ddl}, segment long").parquet(table)

    sizes = stored.groupBy("file", "segment").agg(F.sum("size").alias("size")).collect()
    read = [0] * len(listed)
    for r in sizes:
        read[r["file"]] += r["size"]
    edges = [_beginning_and_end(r["path"], r["length"], n) for r, n in zip(listed, read, strict=True)]
    library = _library()
    states = {number: _advance(library, None, [beginning]) for number, (beginning, _) in enumerate(edges)}
    for at in sorted({r["segment"] for r in sizes}):
        now = {r["file"]: states[r["file"]] for r in sizes if r["segment"] == at}
        states.update(_round(stored.where(c("segment") == at), now, len(listed)))
    release(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return [
        (r["path"].rsplit("/", 1)[-1], _digest(library, _advance(library, states[number], [end])), r["length"])
        for number, (r, (_, end)) in enumerate(zip(listed, edges, strict=True))
    ]


# ------------------------------------------------------------------ hashes and verdicts
def file_hashes(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """SHA-256 and size of every file under ``path``; files beyond ``segment`` bytes are hashed by segments."""
    whole = (c("_metadata.file_size") <= segment) | c("_metadata.file_name").rlike(PACKED)
    if _library() is None:
        whole = F.lit(True)
    hashed = (
        spark.read.format("binaryFile")
        .load(path)
        .where(whole)
        .select(
            F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
            F.sha2("content", 256).alias("actual"),
            c("length").alias("size_bytes"),
        )
    )
    large = _large_hashes(spark, path, lambda files: files.where(~whole), segment)
    return hashed.unionByName(spark.createDataFrame(large, hashed.schema)) if large else hashed


def verify_integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Every file with its declared hash (``manifest``: file_name, declared) and a verdict.

    Hashes are compared without regard to case; an undeclared file is rejected.
    """
    return (
        file_hashes(spark, path)
        .join(manifest.select("file_name", F.lower("declared").alias("declared")), "file_name", "left")
        .withColumn("accepted", F.coalesce(c("actual") == c("declared"), F.lit(False)))
    )
