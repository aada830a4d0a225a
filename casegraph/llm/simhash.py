"""Near-duplicate groups from 64-bit SimHash fingerprints by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so it is a lower bound to filter with.  The counts 0, 1, 2 are kept as the codes
00, 01, 11 of one long (``embed``); the Manhattan distance of two vectors is then the number of
differing bits of their codes.

Range join on a grid: the 32 coordinates are dealt to ``max_distance + 3`` subspaces.  Two vectors
within the distance agree exactly in three subspaces at least, so they share a unit cell of the
grid over one of the choices of three subspaces.  Every distinct fingerprint is put into the cell
of each choice; cells with one member vanish after a counting pass.  Members of a shared cell are
compared by the lower bound and then exactly.  A cell with many members is cut into blocks whose
pairs are separate groups, so no group grows with the data, and each group emits a spanning
forest of its links (one link for each member at most), never all pairs.  No candidate is dropped.

Defined results: a null or empty text has no word and fingerprint zero, linked like any other;
fewer words than a shingle count as one shingle; repeated rows and ids stay as rows; a group whose
ids are all null has a null component; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, free_name, row_keys, table, texts_of
from casegraph.operators.components import connected_components
from casegraph.session import cut_lineage

SEED = 42
SEGMENTS = 32
#: Members of one block of a crowded cell, on average.
BLOCK = 2048
_LOW = 0x5555555555555555
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the word shingles, with repeats: a bit is set if it is in over half of the hashes."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        end = min(n, at + _SHINGLES_AT_ONCE)
        parts = [tokens[at + k : end + k] for k in range(words)]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*parts, strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str, text: str = "text", words: int = 3) -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in texts_of(batch, text)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], [*kept, name]
            )

    return docs.mapInArrow(printed, f"{kinds}, `{name}` long")


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments, as unary codes in one long."""
    low, one = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(one).bitwiseAND(low), fp.bitwiseOR(one).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def _embed_array(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), fp >> np.uint64(1)
    return ((fp & one & low) << np.uint64(1)) | ((fp | one) & low)


def cell_masks(max_distance: int) -> list[int]:
    """For each choice of three subspaces, the (signed) mask of their coordinates."""
    spaces = max_distance + 3
    masks = []
    for chosen in combinations(range(spaces), 3):
        mask = sum(3 << (2 * s) for s in range(SEGMENTS) if s % spaces in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def forest(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints within the distance connect; one for each member at most."""
    code = _embed_array(fp)
    rest = np.arange(1, len(fp))
    queue, left, right = [0], [], []
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        near = np.flatnonzero(np.bitwise_count(code[rest] ^ code[at]) <= max_distance)
        near = near[np.bitwise_count(fp[rest[near]] ^ fp[at]) <= max_distance]
        if len(near):
            found = rest[near].tolist()
            left += [at] * len(found)
            right += found
            queue += found
            rest = np.delete(rest, near)
    return fp[left], fp[right]


def _group_links(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups of a sorted partition; a group may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, sizes = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(keys)])
        pairs = starts[sizes == 2]
        a, b = fps[pairs], fps[pairs + 1]
        near = np.bitwise_count(_embed_array(a) ^ _embed_array(b)) <= max_distance
        near &= np.bitwise_count(a ^ b) <= max_distance
        us, vs = [a[near]], [b[near]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            u, v = forest(fps[start : start + size], max_distance)
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("space", "cell", "i", "j")], axis=1)
        fps = batch.column("fp").to_numpy().view(np.uint64)
        same = (keys == keys[-1]).all(axis=1)
        tail = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
        if tail:
            done = [*held, (keys[:tail], fps[:tail])]
            yield linked(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done]))
            held = []
        elif held and (held[-1][0][-1] != keys[0]).any():
            yield linked(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
            held = []
        held.append((keys[tail:], fps[tail:]))
    if held:
        yield linked(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def links(fps: DataFrame, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """``src, dst`` links among distinct fingerprints (column ``fp``) that connect every group."""
    masks = cell_masks(max_distance)
    spaces = F.array(*(F.struct(F.lit(i).alias("space"), F.lit(m).alias("mask")) for i, m in enumerate(masks)))
    cells = fps.select("fp", F.explode(spaces).alias("s")).select(
        "fp", F.col("s.space").alias("space"), embed(F.col("fp")).bitwiseAND(F.col("s.mask")).alias("cell")
    )
    shared = (
        cells.groupBy("space", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("space", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        cells.join(shared, ["space", "cell"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("space").cast("long").alias("space"),
            "cell",
            F.least("own", "other").cast("long").alias("i"),
            F.greatest("own", "other").cast("long").alias("j"),
            "fp",
        )
    )
    keys = ["space", "cell", "i", "j"]
    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(lambda it: _group_links(it, max_distance), "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, max_distance: int = 3
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; the component is its smallest ``doc_id``."""
    narrow = cut_lineage(
        with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fp", words=words)
    )
    groups = component_ids(narrow, max_distance)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return narrow.join(groups, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def component_ids(narrow: DataFrame, max_distance: int = 3) -> DataFrame:
    """``fp, component, component_id`` for every distinct fingerprint of ``narrow`` (``doc_id, fp``).

    ``component`` is a fingerprint that names the group, ``component_id`` its smallest ``doc_id``.
    """
    fps = cut_lineage(narrow.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = cut_lineage(links(fps.select("fp"), max_distance))
    members = connected_components(edges).select(F.col("node").alias("fp"), "component")
    of = fps.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return of.join(of.groupBy("component").agg(F.min("low").alias("component_id")), "component").select(
        "fp", "component", "component_id"
    )


def group_firsts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, max_distance: int = 3
) -> DataFrame:
    """``k1, k2, id, n``: row key of the row of each group that stays, its id, and its number of equal rows.

    That is the smallest id, of equal ids the smallest key; ids that are null come last.
    """
    k1, k2 = row_keys(docs)
    narrow = cut_lineage(
        with_fingerprints(
            docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
            "fp", words=words,
        )
    )
    rows = narrow.groupBy("k1", "k2").agg(
        F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "n").alias("w")
    first = rows.join(component_ids(narrow, max_distance), "fp").groupBy("component").agg(F.min(order).alias("w"))
    return cut_lineage(first.select("w.k1", "w.k2", F.col("w.doc_id").alias("id"), "w.n"))


def rows_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these keys; rows that are equal in every column are one document."""
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    named = firsts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(free_name(docs, "n")))
    first, second = row_keys(docs)
    marked = docs.withColumns({k1: first, k2: second})
    many = named.where(F.col(named.columns[2]) > 1)
    kept = marked.join(named, [k1, k2], "left_semi")
    if not many.isEmpty():
        once = marked.join(many, [k1, k2], "left_semi")
        numbered = once.withColumn(free_name(marked, "i"), F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(1))))
        once = numbered.where(F.col(numbered.columns[-1]) == 1).drop(numbered.columns[-1])
        kept = kept.join(many, [k1, k2], "left_anti").unionByName(once)
    return kept.select(*(f"`{c}`" for c in docs.columns))


def one_per_group(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, max_distance: int = 3
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, of equal ids any fixed row."""
    return rows_of(docs, group_firsts(docs, text, doc_id, words, max_distance))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
