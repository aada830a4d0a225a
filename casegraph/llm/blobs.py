"""Exchange of many small keys between blocks of documents, as compressed arrays.

A *block* is a set of texts that one task looks at together; it may hold millions of keys.  Sending
each as a row of its own would cost more than the texts.  A block therefore sorts its distinct keys,
cuts them by *part* (a range of hash space) and sends one row ``block, part, keys`` for each part.
Spark groups these rows by part; a task sees each key once for each block, so a key that a third of
all documents hold is as cheap as any.  It answers with one array in the order of the question, and
the answers return to their blocks.

Memory: a part holds about ``KEYS_A_PART`` keys whatever the size of the corpus, as the number of
parts grows with it.  The number of rows grows with blocks times parts; from some TB on, larger
blocks and parts keep it in proportion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that meet in one part, about.
KEYS_A_PART = 2_000_000
LEAST_PARTS = 64
ASKED = "block long, part int, asked binary"
ANSWERED = "block long, part int, answer binary"


def parts_for(keys: int) -> int:
    return max(LEAST_PARTS, -(-keys // KEYS_A_PART))


def squeezed(values: np.ndarray) -> bytes:
    """An array of unsigned integers as byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def ascending(values: np.ndarray) -> bytes:
    """A sorted array of unsigned integers by its differences."""
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def from_ascending(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unsqueezed(data, kind), dtype=kind)


def joined(*arrays: bytes) -> bytes:
    """Several byte strings in one, with their lengths before them."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.uint32)
    return sizes.tobytes() + b"".join(arrays)


def split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()]
    return [data[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def asked_rows(block: int, part: np.ndarray, encode: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each part of a block whose keys are sorted by ``part``; ``encode`` gets a range of them."""
    if not len(part):
        return
    starts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1]
    ends = np.r_[starts[1:], len(part)]
    data = [encode(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([block] * len(data), pa.int64()), pa.array(part[starts].astype(np.int32)), pa.array(data, pa.binary())],
        ["block", "part", "asked"],
    )


def answered(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """``block, part, answer``: what ``answer`` says to the questions of one part; None needs no row."""

    def of_part(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        said = answer(table.column("asked").to_pylist())
        kept = [i for i, x in enumerate(said) if x is not None]
        return pa.table(
            {
                "block": table.column("block").take(pa.array(kept, pa.int64())),
                "part": table.column("part").take(pa.array(kept, pa.int64())),
                "answer": pa.array([said[i] for i in kept], pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(of_part, ANSWERED)


def returned(answers: DataFrame, name: str) -> DataFrame:
    """``block`` and the array ``name`` of its ``part, answer``; it is as large as the block's own keys."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "answer")).alias(name))


def sorted_with_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of 64-bit unsigned keys in ascending order, equal ones in their order, and the keys in that order.

    Each key is sorted as one number with its place in the last bits, which is several times as fast as sorting
    places by keys; where keys differ in those bits only, the nearly sorted places are sorted once more.
    """
    last = np.uint64((1 << max(len(keys) - 1, 0).bit_length()) - 1)
    both = keys & ~last
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & last).view(np.int64)
    if not (keys & last).any():
        both &= ~last
        return order, both
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        again = np.argsort(ranked, kind="stable")
        return order[again], ranked[again]
    return order, ranked


def groups_of(
    keys: np.ndarray, order: np.ndarray | None = None, ranked: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of the keys, the start of each group of equal ones, and the group of each sorted key.  A caller that
    has sorted them gives their order and the keys, or others that are equal where they are, in it."""
    if order is None:
        order = np.argsort(keys, kind="stable")
    if ranked is None:
        ranked = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(first), np.cumsum(first) - 1
