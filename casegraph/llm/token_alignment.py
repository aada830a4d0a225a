"""Alignment of two tokenisations of the same bytes, with corpus-wide counts of linked id pairs.

Both vocabularies tokenise space+text.  Where a token of A and a token of B end at the same byte a group
ends; all pairs of an A and a B token of one group are linked.

* **Identity map.**  For each A id the B id with the same bytes is looked up once.  A group of one token
  on each side is an exact pair ``(a, map[a])``; such pairs are counted in one vector as long as A's
  vocabulary, each task adding up its own.  Only other pairs (of irregular groups) enter the shuffle.
* **Units.**  A space between two characters that are no white space is a boundary in both vocabularies: a
  pre-token of A starts there, and no piece of B has a space after another character (checked when the
  vocabulary is read).  So a text is a sequence of units, tokenised and aligned once for each block of
  documents, all units of a run together in arrays.
* **Blocks.**  A block keeps, compressed, each document's distinct pairs and how often they occur, and asks
  each part of the pair space for the counts of its distinct irregular pairs (``blobs``): pairs are summed
  within a block before they are shuffled, and a pair that every document has is one number a block.
* **Best counts.**  The highest count of each A id is a second vector of A's vocabulary.  Both vectors are
  small for any corpus and go to all tasks; the counts of irregular pairs return to their blocks only.

Defined results: a text that is null, empty, or that one vocabulary does not give back byte by byte has
no tokens, zeros and an empty ``groups_sha256``; repeated rows count each; a text of any length is read
in runs of bounded size; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casegraph.llm import blobs
from casegraph.llm.common import bounded_batches, table
from casegraph.session import cut_lineage

#: Characters of a block and of a run, which is tokenised at once.
BLOCK_CHARS = 8 << 20
RUN_CHARS = 4 << 20
#: Bounds of a worker's memo of tokenised units.
MEMO_UNITS = 500_000
MEMO_CHARS = 40
_B_BITS = 20
_B_MASK = (1 << _B_BITS) - 1

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
# A text without a space next to white space, or at an end, can be split at every space.
_UNEVEN = re.compile(r"\s | \s|\A | \Z")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


class Ragged:
    """Byte strings of a vocabulary in one array."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_places(self.at[ids], self.size[ids])]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start[i] .. start[i] + size[i] - 1`` of all i, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Pair:
    """Two vocabularies, their tokens' bytes, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        special = set(self.a.get_added_tokens_decoder())
        bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            bytes_a[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                bytes_b.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                bytes_b.append(b"")
            else:
                if re.search("[^▁]▁", piece):
                    raise ValueError("a piece goes on beyond a space; units would not be tokenised alike")
                bytes_b.append(piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = Ragged(bytes_a), Ragged(bytes_b)
        # Several B ids may have the same bytes (a letter and its byte); the normal piece is the one used.
        ids = {}
        for i, data in enumerate(bytes_b):
            if data and (data not in ids or not self.b.is_byte(i)):
                ids[data] = i
        self.same = np.array([ids.get(data, -1) for data in bytes_a], np.int64)
        self.memo: dict[str, tuple[bytes, bytes, str]] = {}

    def tokens(self, units: list[str]) -> list[tuple[bytes, bytes, str | None]]:
        """The A and B ids of each unit after a space, as 32-bit numbers, and its groups as text, if known."""
        known = self.memo.get
        out = [known(u) for u in units]
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            texts = [units[i] for i in new]
            ids_a = self.a.encode_batch_fast([" " + u for u in texts], add_special_tokens=False)
            for i, a, b in zip(new, ids_a, self.b.encode(texts, num_threads=1), strict=True):
                out[i] = array("I", a.ids).tobytes(), array("I", b).tobytes(), None
        return out

    def keep(self, units: list[str], tokens: list[tuple[bytes, bytes, str]]) -> None:
        if len(self.memo) + len(units) > MEMO_UNITS:
            self.memo.clear()
        self.memo.update((u, t) for u, t in zip(units, tokens, strict=True) if len(u) <= MEMO_CHARS)


@lru_cache(maxsize=2)
def pair_of(a: str, b: str) -> Pair:
    return Pair(public_tokenizers.path(a), public_tokenizers.path(b))


def units_of(text: str) -> Iterator[list[str]]:
    """The units of a text, in runs of bounded size; the space before each is left out."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > RUN_CHARS and (cut := _BOUNDARY.search(text, at + RUN_CHARS)):
            end = cut.start()
        part = text[at:end] if at or end < len(text) else text
        yield _BOUNDARY.split(part) if _UNEVEN.search(part) else part.split(" ")
        at = end + 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ranges that begin at ``starts``; a range may be empty."""
    whole = np.r_[0, np.cumsum(values)]
    return whole[np.r_[starts[1:], len(values)]] - whole[starts]


class Aligned:
    """The alignment of some distinct units."""

    def __init__(self, pair: Pair, units: list[str]):
        tokens = pair.tokens(units)
        side_a, side_b, shown = zip(*tokens, strict=True) if tokens else ((), (), ())
        count_a, count_b = (np.fromiter(map(len, s), np.int64, len(s)) // 4 for s in (side_a, side_b))
        a, b = (np.frombuffer(b"".join(s), np.uint32).astype(np.int64) for s in (side_a, side_b))
        text = [(" " + u).encode("utf-8", "replace") for u in units]
        size = np.array([len(t) for t in text], np.int64)
        unit_a, unit_b = np.repeat(np.arange(len(units)), count_a), np.repeat(np.arange(len(units)), count_b)
        size_a, size_b = pair.bytes_a.size[a], pair.bytes_b.size[b]
        self.ok = (_sums(size_a, np.cumsum(count_a) - count_a) == size) & (_sums(size_b, np.cumsum(count_b) - count_b) == size)
        # Units whose lengths differ would shift the others' bytes.
        if not self.ok.all():
            in_a, in_b = self.ok[unit_a], self.ok[unit_b]
            a, unit_a, size_a, b, unit_b, size_b = a[in_a], unit_a[in_a], size_a[in_a], b[in_b], unit_b[in_b], size_b[in_b]
            text = [t for t, ok in zip(text, self.ok, strict=True) if ok]
        data = np.frombuffer(b"".join(text), np.uint8)
        differs = (pair.bytes_a.joined(a) != data) | (pair.bytes_b.joined(b) != data)
        if differs.any():
            right = np.flatnonzero(self.ok)
            self.ok[right[np.unique(np.repeat(np.arange(len(right)), size[right])[differs])]] = False
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        common = end_a[np.isin(end_a, end_b, assume_unique=True, kind="sort")] if len(end_a) else end_a
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        of_unit = unit_a[first_a] if len(common) else unit_a
        n = len(units)
        self.n_a, self.n_b, self.n_groups = (np.bincount(x, minlength=n) for x in (unit_a, unit_b, of_unit))
        self.n_links = np.bincount(of_unit, weights=(in_a * in_b).astype(np.float64), minlength=n).astype(np.int64)
        self.shown = list(shown)
        new = [i for i, x in enumerate(shown) if x is None]
        if new:
            asked = np.zeros(n, bool)
            asked[new] = True
            some = asked[of_unit]
            parts = _shown(of_unit[some], a, b, first_a[some], in_a[some], first_b[some], in_b[some])
            for i in new:
                self.shown[i] = ";".join(parts.get(i, ()))
            pair.keep([units[i] for i in new], [(side_a[i], side_b[i], self.shown[i]) for i in new])
        one = (in_a == 1) & (in_b == 1)
        key_one = a[first_a[one]] << _B_BITS | b[first_b[one]]
        unit, key, times = _products(a, b, ~one, first_a, in_a, first_b, in_b, of_unit)
        unit, key, times = np.r_[of_unit[one], unit], np.r_[key_one, key], np.r_[np.ones(len(key_one), np.int64), times]
        order = np.argsort(unit, kind="stable")
        self.key, self.times = key[order], times[order]
        self.count = np.bincount(unit, minlength=n)
        self.at = np.cumsum(self.count) - self.count


def _shown(of_unit, a, b, first_a, in_a, first_b, in_b) -> dict[int, list[str]]:
    """The groups of each unit as text: ``a1,a2|b1`` and so on."""
    parts: dict[int, list[str]] = {}
    a, b = a.tolist(), b.tolist()
    rows = zip(of_unit.tolist(), first_a.tolist(), in_a.tolist(), first_b.tolist(), in_b.tolist(), strict=True)
    for unit, i, k, j, m in rows:
        left = a[i] if k == 1 else ",".join(map(str, a[i : i + k]))
        right = b[j] if m == 1 else ",".join(map(str, b[j : j + m]))
        parts.setdefault(unit, []).append(f"{left}|{right}")
    return parts


def _products(a, b, chosen, first_a, in_a, first_b, in_b, of_unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, pair and number of all links of the chosen groups; equal ids of a side are taken together."""
    groups = np.flatnonzero(chosen)

    def distinct(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = _places(first[groups], count[groups])
        key = np.repeat(np.arange(len(groups)), count[groups]) << _B_BITS | ids[at]
        values, times = np.unique(key, return_counts=True)
        return values >> _B_BITS, values & _B_MASK, times

    group_a, id_a, times_a = distinct(a, first_a, in_a)
    group_b, id_b, times_b = distinct(b, first_b, in_b)
    in_group = np.bincount(group_b, minlength=len(groups))
    start = np.cumsum(in_group) - in_group
    repeat = in_group[group_a]
    left = np.repeat(np.arange(len(group_a)), repeat)
    right = _places(start[group_a], repeat)
    return of_unit[groups][group_a[left]], id_a[left] << _B_BITS | id_b[right], times_a[left] * times_b[right]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, first, _ = blobs.groups_of(keys)
    return keys[order[first]], np.add.reduceat(values[order], first) if len(first) else values


class Sheet:
    """What is kept of the documents of a block: for each its numbers, and its distinct pairs with how often they occur."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.rows: list[tuple] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.chars = 0
        self.waiting: list[tuple[int, list[str]]] = []
        self.run = 0
        self.numbers: list[list] = []

    def add(self, doc_id, text: str | None) -> None:
        doc = len(self.numbers)
        self.numbers.append([doc_id, bool(text), 0, 0, 0, 0, sha256(), False])
        for units in units_of(text or ""):
            self.waiting.append((doc, units))
            self.run += sum(map(len, units)) + len(units)
            if self.run >= RUN_CHARS:
                self._align()
        self.chars += len(text or "")

    def _align(self) -> None:
        index: dict[str, int] = {}
        number = [np.array([index.setdefault(u, len(index)) for u in units], np.int64) for _, units in self.waiting]
        one = Aligned(self.pair, list(index))
        shown = one.shown
        for (doc, _), units in zip(self.waiting, number, strict=True):
            row = self.numbers[doc]
            row[1] = row[1] and bool(one.ok[units].all())
            if row[1]:
                for k, values in enumerate((one.n_a, one.n_b, one.n_groups, one.n_links)):
                    row[2 + k] += int(values[units].sum())
                row[6].update((";" if row[7] else "").encode() + ";".join([shown[i] for i in units.tolist()]).encode())
                row[7] = True
        doc = np.repeat([d for d, _ in self.waiting], [len(u) for u in number])
        unit = np.concatenate(number) if number else np.zeros(0, np.int64)
        of, times = np.unique(doc << 32 | unit, return_counts=True)
        doc, unit = of >> 32, of & 0xFFFFFFFF
        place = _places(one.at[unit], one.count[unit])
        times = np.repeat(times, one.count[unit]) * one.times[place]
        self.found.append(_by_document(np.repeat(doc, one.count[unit]), one.key[place], times))
        self.waiting, self.run = [], 0

    def finished(self) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
        """The documents' numbers, and all (document, pair, times) sorted; documents without tokens have none."""
        if self.waiting:
            self._align()
        doc, key, times = (np.concatenate([f[k] for f in self.found] or [np.zeros(0, np.int64)]) for k in range(3))
        kept = np.array([r[1] for r in self.numbers], bool)[doc]
        return self.numbers, *_by_document(doc[kept], key[kept], times[kept])


def _by_document(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of one document in one row, sorted."""
    codes, place = np.unique(key, return_inverse=True)
    both, total = summed(doc * max(1, len(codes)) + place.reshape(-1), times)
    return both // max(1, len(codes)), codes[both % max(1, len(codes))], total


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


_SHEET = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, regular binary, irregular binary, pairs binary, n_pairs long, vector binary"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _sheets(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[pa.RecordBatch]:
    """A row for each block; the last row of a task has its vector of regular pairs instead."""
    number = TaskContext.get().partitionId() << 32
    vector = np.zeros(len(pair.same), np.int64)
    sheet = Sheet(pair)

    def row(**values) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 3, pa.int64(), pa.binary()]
        columns = [c.split()[0] for c in _SHEET.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([values.get(c)], k) for c, k in zip(columns, kinds, strict=True)], columns)

    def packed() -> pa.RecordBatch:
        numbers, doc, key, times = sheet.finished()
        exact = pair.same[key >> _B_BITS] == key & _B_MASK
        np.add.at(vector, key[exact] >> _B_BITS, 1)
        codes, place = np.unique(key[~exact], return_inverse=True)
        wide, other, often = max(1, len(codes)), doc[~exact], times[~exact]
        regular = doc[exact] * len(pair.same) + (key[exact] >> _B_BITS)
        return row(
            block=number,
            doc_id=[r[0] for r in numbers],
            **{name: [r[2 + k] if r[1] else 0 for r in numbers] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            groups_sha256=[r[6].hexdigest() if r[1] else "" for r in numbers],
            regular=blobs.joined(blobs.ascending(regular.astype(np.uint64)), blobs.squeezed(times[exact].astype(np.uint64))),
            irregular=blobs.joined(
                blobs.ascending((other * wide + place.reshape(-1)).astype(np.uint64)), blobs.squeezed(often.astype(np.uint64))
            ),
            pairs=blobs.joined(
                blobs.ascending(codes.astype(np.uint64)), blobs.squeezed(np.bincount(place.reshape(-1), minlength=len(codes)).astype(np.uint32))
            ),
            n_pairs=len(codes),
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            sheet.add(doc_id, text.as_py())
            if sheet.chars >= BLOCK_CHARS:
                yield packed()
                number, sheet = number + 1, Sheet(pair)
    if sheet.numbers:
        yield packed()
    if vector.any():
        yield row(block=-1, vector=vector.tobytes())


def _dealt(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs of a block by part, and their parts in that order."""
    part = part_of(codes, parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _counted(questions: list[bytes]) -> list[bytes | None]:
    """The documents of all blocks that hold each pair."""
    each = [blobs.split(q) for q in questions]
    found = [blobs.from_ascending(codes, np.uint64) for codes, _ in each]
    held = np.concatenate([blobs.unsqueezed(n, np.uint32) for _, n in each]).astype(np.int64)
    order, first, group = blobs.groups_of(np.concatenate(found))
    counts = np.empty(len(order), np.int64)
    counts[order] = np.add.reduceat(held[order], first)[group]
    ends = np.cumsum([len(n) for n in found])[:-1]
    # The highest count of each A id of the question goes along, for the vector of best counts.
    out = []
    for codes, n in zip(found, np.split(counts, ends), strict=True):
        ids, highest = _highest((codes >> np.uint64(_B_BITS)).astype(np.int64), n)
        out.append(blobs.joined(blobs.squeezed(n.astype(np.uint64)), ids.tobytes(), highest.tobytes()))
    return out


def _highest(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, first, _ = blobs.groups_of(ids)
    return ids[order[first]], np.maximum.reduceat(counts[order], first)


def _best(answers: DataFrame, length: int) -> np.ndarray:
    """For each A id the highest count of an irregular pair; each task sends one vector at most."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(length, np.int64)
        for batch in batches:
            for answer in batch.column("answer"):
                _, ids, counts = blobs.split(answer.as_py())
                np.maximum.at(best, np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64))
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], ["a", "n"])

    out = np.zeros(length, np.int64)
    rows = answers.select("answer").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toPandas()
    out[rows["a"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def alignments(
    docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row; ids are integers."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = cut_lineage(narrow.mapInArrow(lambda batches: _sheets(batches, pair_of(a, b)), _SHEET))
    sheets = stored.where("block >= 0").drop("vector")
    length = len(pair_of(a, b).same)
    summed_vectors = _vector(stored.where("block < 0").select("vector"), length)
    keys = stored.agg(F.sum("n_pairs")).first()[0] or 0
    parts = blobs.parts_for(keys)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs in zip(batch.column("block").to_pylist(), batch.column("pairs"), strict=True):
                data = blobs.split(pairs.as_py())
                codes, held = blobs.from_ascending(data[0], np.uint64), blobs.unsqueezed(data[1], np.uint32)
                order, part = _dealt(codes, parts)
                codes, held = codes[order], held[order]
                yield from blobs.asked_rows(
                    block, part, lambda x, y, c=codes, h=held: blobs.joined(blobs.ascending(c[x:y]), blobs.squeezed(h[x:y]))
                )

    answers = cut_lineage(blobs.answered(sheets.select("block", "pairs").mapInArrow(asked, blobs.ASKED), _counted))
    best = np.maximum(_best(answers, length), summed_vectors)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _results({c: batch.column(c)[i].as_py() for c in batch.schema.names}, parts, summed_vectors, best)

    joined = sheets.drop("n_pairs").join(blobs.returned(answers, "counts"), "block", "left")
    return joined.mapInArrow(results, _RESULT)


def _vector(vectors: DataFrame, length: int) -> np.ndarray:
    """The sum of the tasks' vectors, added up by Spark."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            for one in batch.column("vector"):
                total += np.frombuffer(one.as_py(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["a", "n"])

    out = np.zeros(length, np.int64)
    rows = vectors.mapInArrow(listed, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
    out[rows["a"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _results(sheet: dict, parts: int, vector: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    codes = blobs.from_ascending(blobs.split(sheet["pairs"])[0], np.uint64)
    order, part = _dealt(codes, parts)
    ranked = np.zeros(len(codes), np.int64)
    for one in sheet["counts"] or ():
        x, y = np.searchsorted(part, [one["part"], one["part"] + 1])
        ranked[x:y] = blobs.unsqueezed(blobs.split(one["answer"])[0], np.uint64)
    counts = np.empty(len(codes), np.int64)
    counts[order] = ranked
    n = len(sheet["doc_id"])
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def add(doc: np.ndarray, ids: np.ndarray, held: np.ndarray, times: np.ndarray) -> None:
        np.add.at(n_best, doc, times * (held == best[ids]))
        np.add.at(count_sum, doc, times * held)

    data = blobs.split(sheet["regular"])
    both, times = blobs.from_ascending(data[0], np.uint64).astype(np.int64), blobs.unsqueezed(data[1], np.uint64).astype(np.int64)
    doc, ids = both // len(vector), both % len(vector)
    add(doc, ids, vector[ids], times)
    data = blobs.split(sheet["irregular"])
    both, times = blobs.from_ascending(data[0], np.uint64).astype(np.int64), blobs.unsqueezed(data[1], np.uint64).astype(np.int64)
    doc, place = both // max(1, len(codes)), both % max(1, len(codes))
    add(doc, (codes[place] >> np.uint64(_B_BITS)).astype(np.int64), counts[place], times)
    columns = {c: sheet[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": n_best, "count_sum": count_sum}
    arrays = [pa.array(v, pa.int64()) for v in columns.values()] + [pa.array(sheet["groups_sha256"], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*columns, "groups_sha256"])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
