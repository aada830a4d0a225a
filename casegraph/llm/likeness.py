"""Near copies by the exact likeness of their word shingles.

The likeness of two texts is the Jaccard index of their sets of five-word shingles (the shingles that
SimHash counts).  ``BANDS`` cells of ``BAND`` minimum hashes each bring candidates together: a pair at
``LEAST`` meets in a cell but with probability (1 - 0.8 ** 5) ** 32 = 3e-6, more alike pairs even
surer.  Cells with the same members are looked at once.  In a cell the sets themselves are compared, so
no pair below ``LEAST`` is linked.  Members of a cell meet its leader first, so a crowd of copies gives one
link a row; only what that leaves apart is compared in blocks, each of which emits a spanning forest.

Defined results: a null or empty text has no shingle and is like none; fewer words than a shingle count
as one shingle; rows that are equal in every column go or stay together (SimHash leaves one of them);
further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, free_name, row_keys, texts_of
from casegraph.operators.components import connected_components
from casegraph.session import cut_lineage, release

WORDS = 5
LEAST = 0.8
BANDS = 32
BAND = 5
#: Members of one block of a crowded cell, on average.
BLOCK = 512
_SEED = 42
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 2048


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    odd = rng.integers(1 << 20, 1 << 31, (BANDS * BAND, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    added = rng.integers(0, 1 << 32, (BANDS * BAND, 1)).astype(np.uint32)
    mixed = rng.integers(1, 1 << 62, (BANDS, BAND)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, added, mixed


_ODD, _ADDED, _MIXED = _constants()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), _SEED)], np.uint64)
    one = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    n = len(tokens) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ one[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """The cells of a set of shingles, one for each band."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _AT_ONCE):
        np.minimum(least, (low[at : at + _AT_ONCE] * _ODD + _ADDED).min(axis=1), out=least)
    cells = (least.reshape(BANDS, BAND).astype(np.uint64) * _MIXED).sum(axis=1) + np.arange(BANDS).astype(np.uint64)
    cells = (cells ^ cells >> np.uint64(31)) * _STEP
    return (cells ^ cells >> np.uint64(29)).view(np.int64)


def forest(sets: list[np.ndarray], known: list[int], least: float = LEAST) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of at least this likeness connect; members with one known label are connected."""
    left, right = [], []
    label = np.array(known)
    rest, queue = np.arange(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    while len(rest):
        if not queue:
            queue = rest[label[rest] == label[rest[0]]].tolist()
            rest = rest[label[rest] != label[rest[0]]]
            continue
        at = queue.pop()
        close = rest[np.minimum(sizes[rest], sizes[at]) >= least * np.maximum(sizes[rest], sizes[at])]
        if not len(close):
            continue
        near = close[_alike(sets[at], [sets[i] for i in close], least)]
        left += [at] * len(near)
        right += near.tolist()
        reached = np.isin(label[rest], label[near])
        queue += rest[reached].tolist()
        rest = rest[~reached]
    return left, right


def _alike(one: np.ndarray, others: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Which of the other sets (none is empty) have at least this likeness to ``one``."""
    sizes = np.array([len(s) for s in others])
    joined = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    both = np.add.reduceat((one[place] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
    return both >= least * (sizes + len(one) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Rows, marks and sets of each group of a sorted partition; a group may go on in the next batch."""
    key: tuple | None = None
    rows: list[int] = []
    marks: list[int] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in [*keys, "row", "mark"])
        for (*k, row, mark), data in zip(zip(*columns, strict=True), batch.column("shingles"), strict=True):
            if k != key:
                if len(sets) > 1:
                    yield rows, marks, sets
                key, rows, marks, sets = k, [], [], []
            rows.append(row)
            marks.append(mark)
            sets.append(np.frombuffer(data.as_buffer(), np.uint64))
    if len(sets) > 1:
        yield rows, marks, sets


def _linked(src: list[int], dst: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _leader_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group its leader (first, mark 0) to the members alike."""
    for rows, _, sets in _groups(batches, ["leader", "chunk"]):
        near = np.flatnonzero(_alike(sets[0], sets[1:])) + 1
        if len(near):
            yield _linked([rows[0]] * len(near), [rows[i] for i in near])


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, marks, sets in _groups(batches, ["cell", "i", "j"]):
        left, right = forest(sets, marks)
        if left:
            yield _linked([rows[i] for i in left], [rows[i] for i in right])


def links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``src, dst`` links among the rows of ``docs`` (``row`` long, ``text``) that connect every group."""
    keyed = docs.select(F.col("row").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    return _links(keyed, keyed.select("k1", "k2", F.col("k1").alias("row")).distinct(), block)


def _links(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links among the ``row`` numbers of ``items`` (``k1, k2, row``), whose texts ``docs`` (``k1, k2, text``) has.

    First the members of a cell are compared with its leader (its smallest row) alone, in chunks of a
    fixed size.  What that connects needs no further look; only cells whose members are not all
    connected yet are compared in blocks, and there only what is outside the largest connected part
    with all others.
    """
    bounded_batches(docs.sparkSession)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts_of(batch, "text")]
            cells = pa.array([cells_of(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), cells], ["k1", "k2", "cells"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], ["row", "shingles"])

    found = docs.select("k1", "k2", "text").mapInArrow(celled, "k1 long, k2 long, cells array<long>")
    cells = cut_lineage(found.join(items, ["k1", "k2"]).dropDuplicates(["row"]).select("row", F.explode("cells").alias("cell")))
    mixed = F.xxhash64("row", F.lit("member"))
    # Cells with the same members need one look; several sums tell members apart.
    shared = (
        cells.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("x"), F.min("row").alias("leader"),
            F.sum(F.shiftrightunsigned(mixed, 24)).alias("sum"),
        )
        .where("n > 1")
        .groupBy("n", "x", "leader", "sum")
        .agg(F.min("cell").alias("cell"))
        .select("cell", "leader")
    )
    members = cut_lineage(cells.join(shared, "cell"))
    sets = cut_lineage(
        docs.select("k1", "k2", "text")
        .join(items.join(members.select("row").distinct(), "row", "left_semi"), ["k1", "k2"])
        .dropDuplicates(["row"])
        .select("row", "text")
    )
    pairs = members.where("row <> leader").select("leader", "row").distinct()
    chunks = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    chunked = pairs.join(chunks, "leader").select(
        "leader", F.pmod(mixed, F.col("chunks")).cast("int").alias("chunk"), "row", F.lit(1).cast("long").alias("mark")
    )
    leaders = chunks.select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.col("leader").alias("row"), F.lit(0).cast("long").alias("mark"),
    )
    listed_sets = sets.mapInArrow(listed, "row long, shingles binary")
    stars = chunked.unionByName(leaders).join(listed_sets, "row").repartition("leader", "chunk")
    near = cut_lineage(
        stars.sortWithinPartitions("leader", "chunk", "mark").mapInArrow(_leader_links, "src long, dst long")
    )
    release(docs.sparkSession)
    known = connected_components(near).select(F.col("node").alias("row"), "component")
    labelled = members.join(known, "row", "left").select("cell", "row", F.coalesce("component", "row").alias("mark"))
    parts = labelled.groupBy("cell", "mark").agg(F.count(F.lit(1)).alias("n"))
    open_cells = parts.groupBy("cell").agg(
        F.max(F.struct("n", "mark")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select(
        "cell", F.col("w.mark").alias("largest"),
        F.ceil((F.col("n") - F.col("w.n")) / block).cast("int").alias("apart"),
        F.ceil(F.col("w.n") / block).cast("int").alias("together"),
    )
    # Blocks from 0 hold what is apart, blocks from ``apart`` on the largest part, which meets only the former.
    own = F.when(F.col("mark") == F.col("largest"), F.col("apart") + F.pmod(mixed, F.col("together"))).otherwise(
        F.pmod(mixed, F.col("apart"))
    )
    last = F.when(F.col("mark") == F.col("largest"), F.col("apart") - 1).otherwise(F.col("apart") + F.col("together") - 1)
    dealt = (
        labelled.join(open_cells, "cell")
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "mark")
        .distinct()
        .join(listed_sets, "row")
    )
    keys = ["cell", "i", "j"]
    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys, "row")
    return near.unionByName(grouped.mapInArrow(_group_links, "src long, dst long")).distinct()


def alike_firsts(docs: DataFrame, firsts: DataFrame, text: str = "text") -> DataFrame:
    """``firsts`` (``k1, k2, id, n`` of rows of ``docs``) without those alike to one with a smaller id."""
    k1, k2 = row_keys(docs)
    items = cut_lineage(firsts.withColumn("row", F.monotonically_increasing_id()))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    release(docs.sparkSession)
    edges = cut_lineage(_links(keyed, items.select("k1", "k2", "row")))
    release(docs.sparkSession)
    groups = connected_components(edges)
    members = cut_lineage(items.join(groups.select(F.col("node").alias("row"), "component"), "row"))
    order = F.struct(F.col("id").isNull(), "id", "k1", "k2", "row").alias("w")
    first = members.groupBy("component").agg(F.min(order).alias("w")).select(F.col("w.row").alias("row"))
    others = members.join(first, "row", "left_anti")
    return cut_lineage(items.join(others, "row", "left_anti").select("k1", "k2", "id", "n"))


def one_per_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of texts alike from ``LEAST`` on: the smallest id."""
    k1, k2 = row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("id"))
    firsts = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    first, second = free_name(docs, "k1"), free_name(docs, "k2")
    kept = alike_firsts(docs, firsts, text).select(F.col("k1").alias(first), F.col("k2").alias(second))
    marked = docs.withColumns({first: k1, second: k2})
    return marked.join(kept, [first, second], "left_semi").select(*(f"`{c}`" for c in docs.columns))
