"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Each piece of a document goes where the sum, over all residual gaps, of the squared number of
open bins with that gap becomes smallest: into an open bin with some gap, or into a new one.
The rule keeps the counts of all gaps low and even, so a partner for most lengths stays at hand.

Distribution: only the lengths of pieces matter.  Pieces are dealt to groups of a fixed average
number of pieces, each group is packed in one task, and the rule's state is one counter for each gap
and the open bins.  Bins that a group leaves open are the items of the next round, with fewer
groups, until one group is left or a round merges little; so no task ever sees more than its
group.  All rounds keep whole bins together and only add up offsets.

Defined results: a null or empty text is one piece that holds only the end mark; documents longer
than a sequence are cut into full pieces and a rest; repeated rows and ids are packed each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casegraph.llm.common import bounded_batches, table, texts_of
from casegraph.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Items of one packing group, on average.
GROUP_ITEMS = 50_000
#: Bounds of a worker's memo of encoded words; longer words are encoded anew.
MEMO_WORDS = 400_000
MEMO_CHARS = 40

_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Within ASCII and Latin-1 the vocabulary's splitting pattern reads as below, and lower case is one
# character for one; words of texts with other characters or special strings go to the tokenizer whole.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xff]|<[|]")
_SYMBOL = r"\s0-9a-zªµºß-öø-ÿ²³¹¼½¾"
_PRE_TOKEN = re.compile(
    f"[a-zªµºß-öø-ÿ]+|[^'{_SYMBOL}][^{_SYMBOL}]*|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|'[^{_SYMBOL}]*"
)


def _byte_alphabet() -> dict[int, str]:
    """Maps a byte, read as a Latin-1 character, to the character that stands for it in the vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids, as little-endian bytes, of texts under a vocabulary whose pre-tokens never hold white space.

    White space always ends a pre-token and is dropped, so a text's ids are those of its words in
    order, and a word's ids those of its pre-tokens.  Both are memoised; the merges are the library's.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def _pre_token(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return self._kept(self.pre_tokens, piece, array("I", [t.id for t in self.model.tokenize(shown)]))

    def _word(self, word: str) -> bytes:
        return self._kept(self.words, word, array("I", self.tokenizer.encode(word, add_special_tokens=False).ids))

    @staticmethod
    def _kept(memo: dict[str, bytes], key: str, ids: array) -> bytes:
        if sys.byteorder == "big":
            ids.byteswap()
        found = ids.tobytes()
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[key] = found
        return found

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text):
            parts, known, new = _WORD.findall(text), self.words, self._word
        else:
            parts, known, new = _PRE_TOKEN.findall(text.lower()), self.pre_tokens, self._pre_token
        return b"".join([known.get(p) or new(p) for p in parts])


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as ids with an end mark, cut at the capacity."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(public_tokenizers.path(vocabulary)).ids
        for batch in batches:
            rows, piece, length, crc = [], [], [], []
            texts = texts_of(batch, "text")
            for row, body in enumerate(texts):
                ids = encode(body) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    number,
                    pa.array(np.array(piece, np.int64) * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of every item, in the given order, by the sum-of-squares rule.

    Putting an item of length s into a bin with gap h changes the sum by
    2 * (N[h - s] - N[h]) + 2, or 2 * N[h - s] + 1 where the bin is new; a bin that becomes
    full has no gap and adds nothing.  Of equal changes the smaller remaining gap wins.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    cost = np.empty(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        best, gap = (2 * int(counts[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            held = counts[s:capacity]
            change = cost[: capacity - s]
            np.subtract(counts[: capacity - s], held, out=change)
            change *= 2
            change += 2
            change[0] = 1 - 2 * int(held[0])
            np.putmask(change, held == 0, never)
            i = int(change.argmin())
            if change[i] <= best and held[i]:
                gap = s + i
        if gap == capacity:
            to, made = made, made + 1
        else:
            to = open_bins[gap].pop()
            counts[gap] -= 1
        bins[k], offsets[k] = to, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(to)
    return bins, offsets


def _pack_groups(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """``item, bin, offset`` with bins named by their first item; ``items``: ``item long, length long``."""

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        # A pseudo-random order, which suits the rule and does not depend on how rows arrive.
        frame = frame.sort_values(["order", "item"])
        bins, offsets = place(frame["length"].to_numpy(), capacity)
        items = frame["item"].to_numpy()
        _, first = np.unique(bins, return_index=True)
        return pd.DataFrame({"item": items, "bin": items[first][bins], "offset": offsets})

    dealt = items.withColumn("order", F.xxhash64("item")).withColumn("group", F.pmod("order", F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(packed, "item long, bin long, offset long")


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``item, sequence_id, offset`` for items with a distinct ``item`` number and a ``length`` up to the capacity."""
    placed = None
    current = items.select("item", "length")
    left = current.count()
    done: list[DataFrame] = []
    while left:
        groups = max(1, -(-left // group_items))
        packed = cut_lineage(_pack_groups(current, groups, capacity))
        placed = packed if placed is None else cut_lineage(
            placed.alias("p")
            .join(packed.alias("q"), F.col("p.bin") == F.col("q.item"))
            .select("p.item", F.col("q.bin").alias("bin"), (F.col("p.offset") + F.col("q.offset")).alias("offset"))
        )
        if groups == 1:
            break
        filled = (
            packed.join(current, "item").groupBy(F.col("bin").alias("item")).agg(F.sum("length").alias("length"))
        )
        # Bins with a gap meet those of other groups; full ones are done.
        full = cut_lineage(filled.where(F.col("length") == capacity).select(F.col("item").alias("bin")))
        done.append(placed.join(full, "bin", "left_semi").select("item", "bin", "offset"))
        placed = placed.join(full, "bin", "left_anti").select("item", "bin", "offset")
        current = cut_lineage(filled.where(F.col("length") < capacity))
        before, left = left, current.count()
        if left > 0.9 * before:
            break
    if placed is None:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in done:
        placed = placed.unionByName(part)
    return placed.select("item", F.col("bin").alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = cut_lineage(pieces(docs, capacity=capacity, **names).withColumn("item", F.monotonically_increasing_id()))
    return cut.join(pack(cut, capacity), "item").drop("item")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
