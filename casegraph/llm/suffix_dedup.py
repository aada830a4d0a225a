"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller id.
For this the suffixes of all documents need order, and equality, over their first ``WINDOW`` bytes.

* **Cover sample.**  The positions whose number modulo ``PERIOD`` is in ``COVER`` are sampled.  As every
  difference modulo the period is that of two members, any two positions have an offset below the
  period at which both are in the sample.  So two suffixes that agree in ``WINDOW`` bytes agree in a
  sampled string of ``WINDOW - PERIOD + 1`` bytes at a common offset.  The sampled strings get names
  (hashes) that all blocks exchange; this stands for their ranks, as only ties matter.
* **Ties.**  A suffix none of whose sample names recurs in another document is told apart from all
  others by its sample and is done.  The rest are long ties; a block's ranges of them are stored.
* **Buckets.**  Long ties are dealt to buckets (parts) by a hash of their first ``WINDOW`` bytes.  One
  task sorts one bucket at a time, by 64-bit names that are independent of the bucket's hash; the first
  document of each run of equal suffixes is what the others yield to.  There is a bucket for each so
  many long ties and it is sorted by slices, so memory is bounded at every corpus size, and so is the
  chance of a false tie: fewer than 2^22 suffixes meet in a bucket, so it stays below 2^-42 for each.

Texts are kept once, as compressed blocks of pieces; a document longer than a piece is cut into pieces
that overlap by ``WINDOW - 1`` bytes, so no task depends on the length of a text.  Equal texts are one
text with its smallest id; of the others everything is removed.

Defined results: a null or empty text has 0 bytes and nothing is removed; a null id counts as larger
than every id, and null ids remove nothing from each other, as do rows with equal ids; repeated rows
give a result each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import blobs
from casegraph.llm.common import bounded_batches, table
from casegraph.session import cut_lineage, release

WINDOW = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
SAMPLE = WINDOW - PERIOD + 1
#: Bytes of a block and of a piece of a long document.
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
#: Names that meet in one part, of samples and of long ties, about; a part is answered by slices of ``blobs.KEYS_A_PART``.
SAMPLES_A_PART = 8_000_000
TIES_A_PART = 4_000_000
NO_ID = (1 << 63) - 1

#: Strings that are named at a time, so that the arrays stay in the processor's cache.
_AT_A_TIME = 1 << 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(50).integers(1, 1 << 62, -(-WINDOW // 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = (
    "block long, k1 array<long>, k2 array<long>, doc array<long>, start array<long>, size array<long>, "
    "whole array<boolean>, n_bytes long, data binary"
)
_BY_PIECE = ("k1", "k2", "doc", "start", "size", "whole")
_DONE = "k1 long, k2 long, start long, n_removed long, n_spans long, kept_sha256 string, own binary, runs array<long>"


def names(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of strings of ``width`` bytes, whose ``words`` are the rows of an array."""
    out = np.full(words.shape[1], width, np.uint64)
    for word in words:
        out ^= word
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def parts_of(words: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each string, by a hash that is independent of its name."""
    out = np.zeros(words.shape[1], np.uint64)
    for word, odd in zip(words, _ODD, strict=False):
        out += (word ^ (word >> np.uint64(31))) * odd
    out ^= out >> np.uint64(29)
    out *= _MIX
    return ((out >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``start`` on, one range after another."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that neither meet nor touch, of ranges whose starts and ends both ascend."""
    apart = start[1:] > end[:-1]
    return start[np.r_[True, apart][: len(start)]], end[np.r_[apart, True][: len(end)]]


@dataclass
class Block:
    """Pieces of texts one after another, with what is computed from them."""

    k1: list[int]
    k2: list[int]
    start: np.ndarray
    size: np.ndarray
    whole: list[bool]
    data: bytes
    ids: np.ndarray  # the block's different document ids, sorted
    rank: np.ndarray  # of each piece's document among them

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Block:
        k1, k2, doc, start, size, whole = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in _BY_PIECE)
        ids, rank = np.unique(doc, return_inverse=True)
        packed = batch.column("data")[i].as_py()
        data = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
        return cls(k1.tolist(), k2.tolist(), start, size, whole.tolist(), data, ids, rank.reshape(-1))

    def __post_init__(self) -> None:
        self.at = np.cumsum(self.size) - self.size
        self.piece = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def words(self, at: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """The strings of ``width`` bytes at some positions, a few at a time, as numbers of 8 bytes: one row of the
        array for each 8 bytes, the last one filled up with zeros."""
        n = -(-width // 8)
        strings = np.ndarray(len(self.data), f"V{8 * n}", self.data + bytes(8 * n), strides=(1,))
        for a in range(0, len(at), _AT_A_TIME):
            words = np.ascontiguousarray(strings[at[a : a + _AT_A_TIME]].view("<u8").reshape(-1, n).T)
            words[-1] &= np.uint64((1 << 8 * (width - 8 * (n - 1))) - 1)
            yield slice(a, a + words.shape[1]), words

    def documents(self, at: np.ndarray) -> np.ndarray:
        """The ranks of the documents that hold some positions."""
        return self.rank[self.piece[at]]

    def sampled(self) -> np.ndarray:
        """Sampled positions."""
        starts = np.maximum(self.size - SAMPLE + 1, 0)
        count = starts // PERIOD * len(COVER) + np.searchsorted(COVER, starts % PERIOD)
        number = _spread(np.zeros_like(count), count)
        period = number // len(COVER)
        return np.repeat(self.at, count) + period * PERIOD + np.array(COVER)[number - period * len(COVER)]

    def sorted_samples(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions, their order by part and name, the start of each group of equal names, and the groups'
        parts and names as one number."""
        at = self.sampled()
        name = np.empty(len(at), np.uint64)
        for some, words in self.words(at, SAMPLE):
            name[some] = names(words, SAMPLE)
        key = ((name >> np.uint64(32)) * np.uint64(parts)) & np.uint64(0xFFFFFFFF << 32) | name & np.uint64(0xFFFFFFFF)
        # A part's number has few bits; without the zeros before them there is room for a key's place.
        shift = np.uint64(32 - _bits_of(parts))
        order, ranked = blobs.sorted_with_places(key << shift)
        first = _starts(ranked[1:] != ranked[:-1], len(ranked))
        return at, order, first, ranked[first] >> shift

    def samples(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions, their order by part and name, and of each group of equal names its part, name and
        whether different documents of the block hold it."""
        at, order, first, key = self.sorted_samples(parts)
        last = np.r_[first[1:], len(order)][: len(first)] - 1
        # Pieces lie by document and equal names by place, so a group begins and ends with its extreme documents.
        several = np.flatnonzero(last > first)
        many = np.zeros(len(first), bool)
        many[several] = self.documents(at[order[first[several]]]) != self.documents(at[order[last[several]]])
        return at, order, (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), many

    def tied(self, parts: int, answers: list) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the ranges of positions whose suffixes are in long ties."""
        if not answers:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, order, first, key = self.sorted_samples(parts)
        shared = np.empty(len(at), bool)
        shared[order] = np.repeat(told((key >> np.uint64(32)).astype(np.int64), answers), _counts(first, len(order)))
        held = at[shared]
        piece = self.piece[held]
        # A sampled string is in the suffixes that start up to PERIOD - 1 bytes before it.
        until = self.at + np.clip(self.size - WINDOW + 1, 0, PIECE_BYTES)
        start, end = np.maximum(held - (PERIOD - 1), self.at[piece]), np.minimum(held + 1, until[piece])
        some = start < end
        return _merged(start[some], end[some])

    def sorted_ties(self, parts: int, tied: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Positions of suffixes in long ties, their order by bucket and name, the start of each group of equal ones,
        and buckets and names in that order."""
        tied = _spread(tied[0], tied[1] - tied[0])
        name, bucket = np.empty(len(tied), np.uint64), np.empty(len(tied), np.uint64)
        for some, words in self.words(tied, WINDOW):
            name[some], bucket[some] = names(words, WINDOW), parts_of(words, parts)
        # By bucket and all but the last bits of the name.  Names that differ in these alone could tear a group
        # into two, which the other side puts together as it does with groups of different blocks.
        bits = np.uint64(_bits_of(parts))
        order, _ = blobs.sorted_with_places(bucket << (np.uint64(64) - bits) | name >> bits)
        name, bucket = name[order], bucket[order]
        return tied, order, _starts((name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1]), len(name)), bucket, name

    def ties(self, parts: int, answers: list, tied: tuple | None = None) -> tuple[np.ndarray, ...]:
        """Positions of suffixes in long ties, their order by bucket and name, and of each group of equal ones its
        part, name and the rank of its first document in the block; ``tied``: their ranges, where they are known."""
        tied, order, first, bucket, name = self.sorted_ties(parts, tied or self.tied(parts, answers))
        return tied, order, bucket[first].astype(np.int64), name[first], self.documents(tied[order[first]])

    def removed(self, parts: int, shared: list, yielding: list, tied: tuple | None = None) -> np.ndarray:
        """True for each byte of the block's data that a removed suffix's first ``WINDOW`` bytes cover."""
        tied, order, first, bucket, _ = self.sorted_ties(parts, tied or self.tied(parts, shared))
        held_by = self.documents(tied)[order]
        yields = np.repeat(told(bucket[first].astype(np.int64), yielding), _counts(first, len(order)))
        gone = np.empty(len(tied), bool)
        gone[order] = yields | (held_by > np.repeat(held_by[first], _counts(first, len(order))))
        start, end = _merged(tied[gone], tied[gone] + WINDOW)
        change = np.zeros(len(self.data) + 1, np.int8)
        change[start] = 1
        change[end] = -1
        return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _bits_of(parts: int) -> int:
    """Bits that a part's number takes."""
    return max(1, (parts - 1).bit_length())


def _starts(change: np.ndarray, n: int) -> np.ndarray:
    """The start of each group of ``n`` sorted keys; ``change``: a key differs from the one before."""
    return np.flatnonzero(np.r_[True, change][:n])


def _counts(first: np.ndarray, n: int) -> np.ndarray:
    """The sizes of groups of ``n`` keys."""
    return np.diff(np.r_[first, n]) if n else first


def told(part: np.ndarray, answers: list) -> np.ndarray:
    """The answers' bits for the groups of a block, which are sorted by part; no answer says no."""
    out = np.zeros(len(part), bool)
    for one in answers or ():
        a, b = np.searchsorted(part, [one["part"], one["part"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(one["answer"], np.uint8), count=b - a)
    return out


def _recurring(questions: list[bytes]) -> list[bytes | None]:
    """Bits of the sample names that different documents hold."""
    each = [blobs.split(q) for q in questions]
    found = [blobs.from_ascending(names_, np.uint32) for names_, _ in each]
    many = [np.unpackbits(np.frombuffer(bits, np.uint8), count=len(n)) for (_, bits), n in zip(each, found, strict=True)]

    def recurs(name: np.ndarray, several: np.ndarray) -> np.ndarray:
        order, first, group = blobs.groups_of(name, *blobs.sorted_with_places(name.astype(np.uint64) << np.uint64(32)))
        more = np.diff(np.r_[first, len(order)]) + np.add.reduceat(several[order].astype(np.int64), first) > 1
        return _back(order, more[group])

    return _bits(found, many, recurs)


def _yielding(questions: list[bytes]) -> list[bytes | None]:
    """Bits of the suffixes that a document with a smaller id than the block's first one starts with."""
    each = [blobs.split(q) for q in questions]
    found = [blobs.from_ascending(q[0], np.uint64) for q in each]
    docs = [blobs.from_ascending(ids, np.uint64)[blobs.unsqueezed(which, np.uint32)] for _, ids, which in each]

    def yields(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order, first, group = blobs.groups_of(name, *blobs.sorted_with_places(name))
        doc = doc[order]
        return _back(order, np.minimum.reduceat(doc, first)[group] < doc)

    return _bits(found, docs, yields)


def _back(order: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    bits = np.empty(len(order), bool)
    bits[order] = ranked
    return bits


def _bits(found: list[np.ndarray], also: list[np.ndarray], said: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[bytes | None]:
    """What ``said`` says of all questions' names and what comes with them, by slices of the names' range."""
    slices = max(1, -(-sum(map(len, found)) // blobs.KEYS_A_PART))
    # The names of a question ascend, but for some of the last bits; a slice begins where the last 16 are zeros.
    step = ((1 << 8 * found[0].itemsize) // slices) >> 16 << 16
    between = np.array([step * i for i in range(1, slices)], found[0].dtype)
    cuts = [np.r_[0, np.searchsorted(n, between), len(n)] for n in found]
    bits = [np.empty(len(n), bool) for n in found]
    for i in range(slices):
        here = [slice(c[i], c[i + 1]) for c in cuts]
        name = np.concatenate([n[x] for n, x in zip(found, here, strict=True)])
        if len(name):
            told_ = said(name, np.concatenate([a[x] for a, x in zip(also, here, strict=True)]))
            for b, x, part in zip(bits, here, np.split(told_, np.cumsum([x.stop - x.start for x in here])[:-1]), strict=True):
                b[x] = part
    return [np.packbits(b).tobytes() if b.any() else None for b in bits]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces from rows ``k1, k2, doc, text``; in a block they lie by document."""
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        rows.sort(key=lambda row: row[2])
        k1, k2, doc, start, length, whole, parts = zip(*rows, strict=True)
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
        values = [[number], [k1], [k2], [doc], [start], [length], [whole], [sum(length)], [data]]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.bool_()), pa.int64(), pa.binary()]
        names_ = ["block", "k1", "k2", "doc", "start", "size", "whole", "n_bytes", "data"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names_)

    for batch in batches:
        for k1, k2, doc, text in zip(*(batch.column(c) for c in ("k1", "k2", "doc", "text")), strict=True):
            body = (text.as_py() or "").encode("utf-8", "replace")
            whole = len(body) <= PIECE_BYTES
            # The last piece has at least one window of its own, or is the only one.
            for at in range(0, 1 if whole else max(1, len(body) - WINDOW + 1), PIECE_BYTES):
                piece = body[at : at + PIECE_BYTES + WINDOW - 1]
                rows.append((k1.as_py(), k2.as_py(), doc.as_py(), at, len(piece), whole, piece))
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield packed()
                    number, rows, size = number + 1, [], 0
    if rows:
        yield packed()


def _finished(block: Block, gone: np.ndarray) -> Iterator[tuple]:
    """A result for each whole document; for a piece its own bytes and the runs removed, by place in the document."""
    data = np.frombuffer(block.data, np.uint8)
    kept = memoryview(data[~gone])
    bounds = np.r_[block.at, len(data)]
    before = np.r_[0, np.cumsum(gone)][bounds]
    n_removed = np.diff(before)
    began = gone & ~np.r_[False, gone[:-1]]
    first = block.at[block.size > 0]
    began[first] = gone[first]
    n_spans = np.diff(np.searchsorted(np.flatnonzero(began), bounds))
    ends = bounds - before
    keys = zip(block.k1, block.k2, block.start.tolist(), strict=True)
    for i, (key, n, spans) in enumerate(zip(keys, n_removed.tolist(), n_spans.tolist(), strict=True)):
        if block.whole[i]:
            yield (*key, n, spans, sha256(kept[ends[i] : ends[i + 1]]).hexdigest(), None, None)
        else:
            mask, body = (x[bounds[i] : bounds[i + 1]] for x in (gone, data))
            change = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            yield (*key, None, None, None, body.tobytes(), (change + block.start[i]).tolist())


class _Whole:
    """Result of a document whose pieces come in order."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.end, self.until, self.tail = key, 0, 0, b""
        self.n_removed = self.n_spans = 0
        self.before, self.hashed = False, sha256()

    def add(self, start: int, own: bytes, runs: list[int]) -> None:
        body, self.tail = own[:PIECE_BYTES], own[PIECE_BYTES:]
        self._add(start, body, runs)

    def _add(self, start: int, body: bytes, runs: list[int]) -> None:
        mask = np.zeros(len(body), bool)
        mask[: max(0, self.until - start)] = True
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            mask[a - start : b - start] = True
            self.until = max(self.until, b)
        begun = mask & ~np.r_[self.before, mask[:-1]] if len(mask) else mask
        self.n_removed += int(np.count_nonzero(mask))
        self.n_spans += int(np.count_nonzero(begun))
        self.before = bool(mask[-1]) if len(mask) else self.before
        self.hashed.update(np.frombuffer(body, np.uint8)[~mask].tobytes())
        self.end = start + len(body)

    def result(self) -> pa.RecordBatch:
        # What the last piece has beyond its own windows; removed runs that reach into it began before.
        self._add(self.end, self.tail, [])
        values = [[self.key[0]], [self.key[1]], [self.n_removed], [self.n_spans], [self.hashed.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


def _long_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents in pieces, which come sorted by document and place."""
    one: _Whole | None = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("k1", "k2", "start", "own", "runs"))
        for k1, k2, start, own, runs in zip(*columns, strict=True):
            if one is None or one.key != (k1, k2):
                if one:
                    yield one.result()
                one = _Whole((k1, k2))
            if start == one.end:  # else it is the same document once more
                one.add(start, own, runs)
    if one:
        yield one.result()


def removed_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; ids are integers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.xxhash64(F.lit(0), body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), body.alias("text"),
    )
    narrow = cut_lineage(keyed.select("k1", "k2", "doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = narrow.groupBy("k1", "k2").agg(F.min("doc").alias("doc"))
    texts = keyed.select("k1", "k2", "doc", "text").join(firsts, ["k1", "k2", "doc"], "left_semi")
    # Read twice below; without the stored table all its work would be done twice.
    done = cut_lineage(_pieces_done(cut_lineage(texts.mapInArrow(_blocks, _BLOCK))))
    whole = done.where("own IS NULL").select("k1", "k2", "n_removed", "n_spans", "kept_sha256")
    cut = done.where("own IS NOT NULL").select("k1", "k2", "start", "own", "runs")
    long_ones = cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start").mapInArrow(
        _long_documents, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string"
    )
    results = whole.unionByName(long_ones).dropDuplicates(["k1", "k2"]).join(firsts.withColumnRenamed("doc", "first"), ["k1", "k2"])
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= WINDOW)
    return narrow.join(results, ["k1", "k2"]).select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def _pieces_done(blocks: DataFrame) -> DataFrame:
    """A row for each piece of ``blocks``: the result of a whole document, or the piece's bytes and runs."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(blobs.LEAST_PARTS, -(-total * len(COVER) // (PERIOD * SAMPLES_A_PART)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _single(batches):
            _, _, part, name, many = Block.of(batch, i).samples(parts)
            yield from blobs.asked_rows(
                batch.column("block")[i].as_py(),
                part,
                lambda a, b, n=name, m=many: blobs.joined(blobs.ascending(n[a:b]), np.packbits(m[a:b]).tobytes()),
            )

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _single(batches):
            start, end = Block.of(batch, i).tied(parts, batch.column("shared")[i].as_py())
            if not len(start):
                continue
            ranges = blobs.joined(*(blobs.squeezed(x.astype(np.uint32)) for x in (start, end)))
            values = [[batch.column("block")[i].as_py()], [int((end - start).sum())], [ranges]]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "n_tied", "tied"])

    shared = cut_lineage(blobs.returned(blobs.answered(blocks.mapInArrow(sampled, blobs.ASKED), _recurring), "shared"))
    release(spark)  # the shuffles of the texts and the sample names
    ranges = cut_lineage(blocks.join(shared, "block").mapInArrow(tied, "block long, n_tied long, tied binary"))
    release(spark)  # that of the blocks
    buckets = max(blobs.LEAST_PARTS, -(-(ranges.agg(F.sum("n_tied")).first()[0] or 0) // TIES_A_PART))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _single(batches):
            block = Block.of(batch, i)
            _, _, part, name, low = block.ties(buckets, [], _ranges(batch, i))

            def coded(a: int, b: int, block: Block = block, name: np.ndarray = name, low: np.ndarray = low) -> bytes:
                held = np.zeros(len(block.ids), bool)
                held[low[a:b]] = True
                ids = block.ids[held].view(np.uint64) ^ np.uint64(1 << 63)  # the same order without a sign
                which = (np.cumsum(held, dtype=np.uint32) - np.uint32(1))[low[a:b]]
                return blobs.joined(blobs.ascending(name[a:b]), blobs.ascending(ids), blobs.squeezed(which))

            yield from blobs.asked_rows(batch.column("block")[i].as_py(), part, coded)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
        columns = ["k1", "k2", "start", "n_removed", "n_spans", "kept_sha256", "own", "runs"]
        for batch, i in _single(batches):
            block = Block.of(batch, i)
            gone = block.removed(buckets, [], batch.column("yielding")[i].as_py(), _ranges(batch, i))
            rows = zip(*_finished(block, gone), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], columns)

    def with_ranges() -> DataFrame:
        return blocks.join(ranges, "block", "left")

    # A frame kept in a name would keep the shuffles of all jobs that ran over it.
    yielding = cut_lineage(blobs.returned(blobs.answered(with_ranges().mapInArrow(dealt, blobs.ASKED), _yielding), "yielding"))
    release(spark)  # that of the long ties
    return with_ranges().join(yielding, "block", "left").mapInArrow(finished, _DONE)


def _ranges(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ranges of tied positions; none where no name of it is shared."""
    stored = batch.column("tied")[i].as_py()
    if stored is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = (blobs.unsqueezed(x, np.uint32).astype(np.int64) for x in blobs.split(stored))
    return start, end


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents"))
