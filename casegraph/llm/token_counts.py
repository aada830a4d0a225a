"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token starts as a chain of byte symbols.  A heap holds every adjacent pair that has a
merge rank; the lowest (rank, position) is popped, the right symbol is unlinked and the two new
neighbouring pairs are pushed.  The count of a pre-token is its number of initial symbols minus
its number of merges; no identifier is emitted.

Defined results: a null or empty text has 0 tokens; a text of any length is counted whole, in
O(n log n); repeated rows are counted each; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from casegraph.llm.common import bounded_batches, table, texts_of

#: Bounds of a worker's memo of counted pre-tokens; longer ones are counted anew.
MEMO_PIECES = 500_000
MEMO_CHARS = 40

_BITS = 24
_MASK = (1 << _BITS) - 1

# Within ASCII and Latin-1 the standard library's (faster) expressions split as the vocabulary's
# pattern does; letters come first because the alternatives start with different characters.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xff]")
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PRE_TOKEN = re.compile(
    f" ?[{_LETTER}]+| ?[{_DIGIT}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{_LETTER}{_DIGIT}]+|\\s+(?!\\S)|\\s+"
)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(extra)
            extra += 1
    return [symbols[b] for b in range(256)]


class MergeCounter:
    """Counts tokens under the merges and the special strings of one vocabulary file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids: dict[str, int] = {}
        for symbol in _byte_symbols():
            ids.setdefault(symbol, len(ids))
        self.first = [ids[s] for s in _byte_symbols()]
        # A pair of symbols, and a rank with the joined symbol, are kept as one integer each.
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pair = ids.setdefault(a, len(ids)) << _BITS | ids.setdefault(b, len(ids))
            self.merges.setdefault(pair, rank << _BITS | ids.setdefault(a + b, len(ids)))
        self.pattern = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.standard = pattern == public_tokenizers.PATTERN
        self.memo: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols left of one pre-token after all merges."""
        n, rule, first = len(data), self.merges.get, self.first
        if n < 2:
            return n
        symbols = [first[b] for b in data]
        # rules[i]: what the pair that starts at symbol i merges by, -1 for nothing.
        rules = [rule(a << _BITS | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        rules.append(-1)
        heap = [(r >> _BITS) * n + i for i, r in enumerate(rules) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left = n
        while heap:
            key = heappop(heap)
            i = key % n
            r = rules[i]
            if r < 0 or (r >> _BITS) * n + i != key:
                continue  # the pair has changed meanwhile
            joined = symbols[i] = r & _MASK
            gone = after[i]
            rules[gone] = -1
            k = after[i] = after[gone]
            left -= 1
            if k < n:
                before[k] = i
                r = rules[i] = rule(joined << _BITS | symbols[k], -1)
                if r >= 0:
                    heappush(heap, (r >> _BITS) * n + i)
            else:
                rules[i] = -1
            h = before[i]
            if h >= 0:
                r = rules[h] = rule(symbols[h] << _BITS | joined, -1)
                if r >= 0:
                    heappush(heap, (r >> _BITS) * n + h)
        return left

    def _new(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8", "replace"))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        pieces = (_PRE_TOKEN if self.standard and not _OTHER.search(text) else self.pattern).findall(text)
        known, new = self.memo, self._new
        return sum([known.get(p) or new(p) for p in pieces])

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(maxsize=4)
def counter(path: str, pattern: str = public_tokenizers.PATTERN) -> MergeCounter:
    """One counter, with its memo, for each worker process and vocabulary."""
    return MergeCounter(path, pattern)


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    text: str = "text",
    doc_id: str = "doc_id",
    limit: int = 1024,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(vocabulary)).count
        for batch in batches:
            texts = texts_of(batch, "text")
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
