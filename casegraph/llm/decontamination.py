"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it finds.

Learning: texts are cut into passages of ``PASSAGE`` words.  A first pass counts, for each term (a hash
bucket of a word), the passages that hold it.  A second pass multiplies the TF-IDF matrix of all
passages, and then its transpose, with a sparse random matrix (one sign for each term); the orthonormal
basis of the sum over all tasks, refined by the small eigenproblem, spans the leading right singular
vectors (randomised SVD with one power step).  Passages are scaled to length one by the length of their
sketch.  Tasks add up tables of fixed size, which Spark sums in row ranges.

Search: benchmark items are the query set and are sent in blocks of ``ITEMS_AT_ONCE`` to every document.
Words are projected and added up in steps of ``STEP`` words, so windows near each item's length
come from few sums.  A window whose cosine with an item reaches ``MIN_COSINE`` in the latent space is a
candidate; nothing else limits candidates.  A candidate is a leak if the longest common subsequence
of item words and window words covers ``MIN_COVER`` of the item, or ``MIN_COVER_ANSWER`` where the
window also holds the item's answer (its last ``ANSWER`` words, in a row).

Defined results: null and empty texts and items match nothing; repeated items match each; an item
shorter than ``MIN_WORDS`` words is too little evidence and matches nothing; repeated documents are
reported each, as one row for each (document, item); further columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.byte_words import Words, split
from casegraph.llm.common import bounded_batches, kept_rows, table

TERM_BITS = 14
TERMS = 1 << TERM_BITS
RANK = 36
SKETCH = 44
PASSAGE = 48
STEP = 8
MIN_WORDS = 8
MIN_COSINE = 0.5
MIN_COVER = 0.7
MIN_COVER_ANSWER = 0.5
ANSWER = 5
ITEMS_AT_ONCE = 1000
#: Longer items are searched by pieces of so many words; a leaked piece is a leak of the item.
PIECE = 96
#: Classes of words in the quick count of a piece's words; more classes let fewer chance hits pass.
SEEN = 1024
RANGE = 2048
#: Bytes of the texts whose windows are compared in one go; a longer text is one alone.
AT_ONCE = 1 << 19

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(texts: pa.Array, limit: int = AT_ONCE) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``limit`` bytes together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > limit:
            yield texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts[start:]


def passages(words: Words) -> tuple[np.ndarray, int]:
    """The number of the passage each word is in (dense, from 0), and how many there are."""
    made = -(-words.counts // PASSAGE)
    first = np.repeat(np.cumsum(words.counts) - words.counts, words.counts)
    inside = (np.arange(len(words.terms)) - first) // PASSAGE
    return inside + np.repeat(np.cumsum(made) - made, words.counts), int(made.sum())


def _summed_tables(docs: DataFrame, text: str, columns: int, add) -> np.ndarray:
    """Sum over all texts of a TERMS x ``columns`` table that ``add(words, table)`` adds to, by row ranges."""
    ranges = TERMS // RANGE

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, columns))
        for batch in batches:
            for part in parts(batch.column("text")):
                add(split(part, TERM_BITS), total)
        sums = [total[i * RANGE : (i + 1) * RANGE].astype(np.float32).tobytes() for i in range(ranges)]
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(sums, pa.binary())], ["range", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(RANGE * columns)
        for sums in frame["sums"]:
            total += np.frombuffer(sums, np.float32)
        return pd.DataFrame({"range": frame["range"].iloc[:1], "salt": [0], "sums": [total.astype(np.float32).tobytes()]})

    # Two steps, so that one task never reads the tables of all tasks.
    fields = "range int, salt int, sums binary"
    tables = docs.select(F.col(text).alias("text")).mapInArrow(own, "range int, sums binary")
    salted = tables.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    partial = salted.groupBy("range", "salt").applyInPandas(added, fields)
    out = np.zeros((TERMS, columns))
    for r in partial.groupBy("range").applyInPandas(added, fields).collect():
        out[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(r["sums"], np.float32).reshape(RANGE, columns)
    return out


def passage_frequencies(words: Words, total: np.ndarray) -> None:
    """Add, for each term, the passages that hold it; the last row of column 1 counts all passages."""
    if not len(words.terms):
        return
    passage, made = passages(words)
    order = np.argsort(words.terms, kind="stable")
    term, row = words.terms[order], passage[order]
    new = np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]
    total[:, 0] += np.bincount(term[new], minlength=TERMS)
    total[-1, 1] += made


def test_matrix() -> tuple[np.ndarray, np.ndarray]:
    """The sparse random matrix: the column and the sign of each term's single entry."""
    rng = np.random.default_rng(11)
    return rng.integers(0, SKETCH, TERMS), rng.choice([-1.0, 1.0], TERMS)


def gram_sketch(words: Words, idf: np.ndarray, total: np.ndarray) -> None:
    """Add A^T (A test) / idf for the TF-IDF rows of these texts' passages, each of about length one."""
    if not len(words.terms):
        return
    column, sign = test_matrix()
    passage, made = passages(words)
    sketch = np.bincount(
        passage * SKETCH + column[words.terms], (sign * idf)[words.terms], made * SKETCH
    ).reshape(made, SKETCH)
    sketch = np.asfortranarray(sketch / np.maximum((sketch**2).sum(axis=1, keepdims=True), 1e-9))
    for d in range(SKETCH):
        total[:, d] += np.bincount(words.terms, sketch[:, d][passage], TERMS)


@dataclass
class LatentSpace:
    """TERMS x RANK projection: a word's weight times its row of right singular vectors, whitened."""

    projection: np.ndarray

    def of(self, text: str) -> np.ndarray:
        v = self.projection[split(pa.array([text]), TERM_BITS).terms].sum(axis=0)
        return v / max(float(np.linalg.norm(v)), 1e-9)


def fit(docs: DataFrame, text: str = "text") -> LatentSpace:
    """The latent space of all passages of all texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = _summed_tables(docs, text, 2, passage_frequencies)
    total = max(1.0, counts[-1, 1])
    # Smoothed as usual; a term in every passage keeps a small weight.
    idf = np.log((total + 1) / (counts[:, 0] + 1)) + 0.05
    shared = spark.sparkContext.broadcast(idf)
    gram = _summed_tables(docs, text, SKETCH, lambda words, sums: gram_sketch(words, shared.value, sums))
    gram *= idf[:, None]
    column, sign = test_matrix()
    test = np.zeros((TERMS, SKETCH))
    test[np.arange(TERMS), column] = sign
    # gram = G test with G = A^T A.  Nystrom: G is close to gram (test^T gram)^+ gram^T.
    basis, triangle = np.linalg.qr(gram)
    core = test.T @ gram
    inner = triangle @ np.linalg.pinv((core + core.T) / 2, rcond=1e-6, hermitian=True) @ triangle.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(values)[::-1][:RANK]
    scale = np.sqrt(np.maximum(values[top], 0))
    keep = scale > 1e-6 * max(scale[0], 1e-9)
    right = basis @ vectors[:, top[keep]] / scale[keep]
    return LatentSpace((right * idf[:, None]).astype(np.float32))


@dataclass
class Piece:
    """A benchmark item, or a part of a long one."""

    item: int
    words: list[str]
    answer: list[str]


def pieces_of(item: int, text: str | None) -> list[Piece]:
    words = words_of(text or "")
    out = []
    for start in range(0, max(1, len(words) - MIN_WORDS + 1), PIECE):
        part = words[start : start + PIECE]
        if len(words) - start - PIECE < MIN_WORDS:
            part = words[start:]
        if len(part) >= MIN_WORDS:
            out.append(Piece(item, part, words[-ANSWER:]))
    return out


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def holds(words: list[str], run: list[str]) -> bool:
    n = len(run)
    return n > 0 and any(words[i] == run[0] and words[i : i + n] == run for i in range(len(words) - n + 1))


class Searcher:
    """Benchmark pieces by the number of steps of the windows that they are compared with."""

    def __init__(self, space: LatentSpace, pieces: list[Piece]):
        self.pieces = pieces
        self.projection = np.vstack([space.projection, np.zeros_like(space.projection[:1])])
        self.counts = [Counter(p.words) for p in pieces]
        found = [split(pa.array([" ".join(p.words)]), TERM_BITS).terms % SEEN for p in pieces]
        # The pieces' words, filled up with a number that no window holds.
        self.seen = np.full((len(pieces), max(map(len, found))), SEEN + 1)
        for i, terms in enumerate(found):
            self.seen[i, : len(terms)] = terms
        self.sizes = np.array([len(p.words) for p in pieces])
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            groups.setdefault(max(1, round(len(p.words) / STEP)), []).append(i)
        self.groups = {
            steps: (np.array(members), np.stack([space.of(" ".join(pieces[i].words)) for i in members]).T)
            for steps, members in sorted(groups.items())
        }

    def candidates(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """``(text, first word, end, piece)`` of windows whose cosine with a piece reaches the threshold.

        Windows start at every step; at the end of a text they are shorter.
        """
        counts = -(-words.counts // STEP)
        firsts = np.cumsum(counts) - counts
        padded = np.full(int(counts.sum()) * STEP, TERMS, np.int32)  # the row of TERMS is zero
        before = np.cumsum(words.counts) - words.counts
        padded[np.arange(len(words.terms)) + np.repeat(firsts * STEP - before, words.counts)] = words.terms
        steps_of = [
            self.projection[padded[i : i + (STEP << 12)]].reshape(-1, STEP, self.projection.shape[1]).sum(axis=1)
            for i in range(0, len(padded), STEP << 12)
        ]
        if not steps_of:
            return
        sums = np.concatenate(steps_of)
        owner = np.repeat(np.arange(len(counts)), counts)
        windows, size = sums.copy(), 1
        for steps, (members, queries) in self.groups.items():
            while size < steps:  # grow the windows of the last group by single steps
                if size < len(sums):
                    windows[:-size] += sums[size:] * (owner[size:] == owner[:-size])[:, None]
                size += 1
            least = MIN_COSINE * np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
            at, which = np.nonzero(windows @ queries >= least)
            start, piece = (at - firsts[owner[at]]) * STEP, members[which]
            likely = self.present(words, before, owner[at], start, steps, piece) >= MIN_COVER_ANSWER * self.sizes[piece]
            yield from zip(
                owner[at][likely].tolist(), start[likely].tolist(), (start[likely] + steps * STEP).tolist(),
                piece[likely].tolist(), strict=True,
            )

    def present(self, words: Words, before, text, start, steps: int, piece) -> np.ndarray:
        """How many words of each piece occur in its window and the margin: never below a common subsequence."""
        number = before[text] + start
        windows, which = np.unique(number, return_inverse=True)
        _, any_ = np.unique(number, return_index=True)
        at = windows[:, None] + np.arange(-STEP, (steps + 1) * STEP)
        first, last = before[text[any_]], before[text[any_]] + words.counts[text[any_]]
        outside = (at < first[:, None]) | (at >= last[:, None])
        terms = words.terms[np.clip(at, 0, len(words.terms) - 1)] % SEEN
        holds_ = np.zeros((len(windows), SEEN + 2), bool)
        holds_[np.arange(len(windows))[:, None], np.where(outside, SEEN, terms)] = True
        out = np.empty(len(piece), np.int64)
        for i in range(0, len(piece), 4096):
            out[i : i + 4096] = holds_[which[i : i + 4096, None], self.seen[piece[i : i + 4096]]].sum(axis=1)
        return out

    def leaks(self, texts: pa.Array) -> list[dict[int, tuple[float, bool, int]]]:
        """Of each text's leaked items: the best cover, whether the answer is there, and the place's first word."""
        return [found for part in parts(texts) for found in self._leaks(part)]

    def _leaks(self, texts: pa.Array) -> list[dict[int, tuple[float, bool, int]]]:
        words = split(texts, TERM_BITS)
        before = np.cumsum(words.counts) - words.counts
        best: list[dict[int, tuple[float, bool, int]]] = [{} for _ in range(len(texts))]
        held: tuple = ()
        for text, start, end, i in self.candidates(words):
            piece, m = self.pieces[i], len(self.pieces[i].words)
            # The window may be off by some steps; a passage lies inside it and a margin.
            at = max(0, start - STEP)
            if held[:3] != (text, at, end):  # candidates come window by window
                last = min(end + STEP, int(words.counts[text]))
                part = words_of(words.text(before[text] + at, before[text] + last))
                held = (text, at, end, part, Counter(part))
            part, there = held[3:]
            if sum([min(n, there[w]) for w, n in self.counts[i].items() if w in there]) < MIN_COVER_ANSWER * m:
                continue  # an upper bound of the subsequence
            cover = common_subsequence(piece.words, part) / m
            if cover < MIN_COVER_ANSWER:
                continue
            answer = holds(part, piece.answer)
            if (cover >= MIN_COVER or answer) and cover > best[text].get(piece.item, (0.0,))[0]:
                best[text][piece.item] = (cover, answer, at)
        return best


def searchers(space: LatentSpace, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[Searcher]:
    """The query set in blocks of bounded size."""
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text")
    block: list[Piece] = []
    for r in rows.toLocalIterator():
        block += pieces_of(r["item_id"], r["text"])
        if len(block) >= at_once:
            yield Searcher(space, block)
            block = []
    if block:
        yield Searcher(space, block)


def leaks(docs: DataFrame, benchmark: DataFrame, space: LatentSpace) -> DataFrame:
    """``doc_id, item_id, cover, answer, word``: leaked items of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, cover double, answer boolean, word long"
    out = spark.createDataFrame([], schema)
    for searcher in searchers(space, benchmark):
        shared = spark.sparkContext.broadcast(searcher)  # the space and ITEMS_AT_ONCE pieces

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, hits = [], []
                for i, hit in enumerate(shared.value.leaks(batch.column("text"))):
                    for item, (cover, answer, word) in sorted(hit.items()):
                        rows.append(i)
                        hits.append((item, cover, answer, word))
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.int64())
                columns += [pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cover", "answer", "word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(found, schema))
    return out


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, space: LatentSpace, text: str = "text") -> DataFrame:
    """The rows whose text leaks no benchmark item."""
    for searcher in searchers(space, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)
        docs = kept_rows(docs, text, lambda texts, shared=shared: [not hit for hit in shared.value.leaks(pa.array(texts, pa.string()))])
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leaks(docs, table(spark, sf_dir, "benchmark"), fit(docs))
