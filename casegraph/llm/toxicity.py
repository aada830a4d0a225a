"""Toxicity by a linear-chain conditional random field over tokens.

Labelled tokens come from labelled documents: words and word beginnings that are far more frequent in
toxic than in clean sample documents (counted in Spark, and tested against chance among all of them)
mark the tokens of toxic documents as toxic; a toxic document without such a word is marked by its
best-ranked one, if that one alone is unlikely by chance.  So no absolute number of labelled rows is
asked for.  All tokens of clean documents are clean.  The field learns weights of hashed word, prefix and suffix
features, of the neighbouring words, and of tag pairs.  Forward-backward marginals give each token's
probability; a document's score comes from the largest one and from the expected number of toxic tokens,
calibrated on the sample.  ``toxic_spans`` reports the offsets of the offending tokens.

Everything is fitted on a bounded sample of labelled rows that are not held out: about ``SAMPLE_TOXIC``
toxic and ``SAMPLE_CLEAN`` clean documents, and at most about ``SENTENCES`` sentences of them.  No label,
language, source or id enters a score.  A sentence ends at a line end or a full stop, question or
exclamation mark; it is one chain, of any length.

Defined results: null and empty texts have no token and get the lowest score; without labels of both
kinds, or where no word tells them apart, every score is 0; repeated rows stay; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, held_out, kept_rows, sample_below, slices, table, texts_of
from casegraph.llm.crf import marginals
from casegraph.session import cut_lineage

SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 3000
SENTENCES = 12_000
SENTENCE_TOKENS = 60
FEATURE_BITS = 16
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
#: A word or beginning marks tokens from this ratio of shares on, if chance gives one such among all words
#: with at most this probability; a toxic document's best-ranked word, if chance gives it alone with at most this.
MIN_RATIO = 20.0
CHANCE = 0.05
MEMO_WORDS = 150_000
FLOOR = 1e-7

_TOKEN = re.compile(r"\w+|[.?!\n]")
_BREAKS = frozenset(".?!\n")


def word_features(word: str) -> list[str]:
    """The word itself, its beginnings and its ending; what the field sees of a token."""
    w = word.lower()
    return [f"w={w}", *(f"p{n}={w[:n]}" for n in PREFIXES if len(w) >= n), f"s3={w[-3:]}"]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


@dataclass
class Field:
    """Weights: hashed own features, hashed neighbouring words, tag pairs; and the calibration."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    transition: np.ndarray
    initial: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))
    memo: dict[str, int] = field(default_factory=dict)
    parts: np.ndarray = field(default_factory=lambda: np.zeros((1024, 3)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}, "parts": np.zeros((1024, 3))}

    def _learn(self, word: str) -> int:
        """Number of a word whose scores were not known; the word itself, the next word, the one before."""
        slots = [_slot(f) for f in word_features(word)]
        n = self.memo[word] = len(self.memo)
        if n >= len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        own, w = self.own, slots[0]
        self.parts[n] = sum([own[s] for s in slots], self.bias), self.before[w], self.after[w]
        return n

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each word being toxic, and the number of words of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        known, learn = self.memo, self._learn
        split = [_TOKEN.findall(t) for t in texts]
        # Breaks are numbered like words, with the number -1.
        numbers = np.array(
            [-1 if t in _BREAKS else n if (n := known.get(t)) is not None else learn(t) for ts in split for t in ts], np.int64
        )
        text_of = np.repeat(np.arange(len(texts)), [len(ts) for ts in split])
        word = numbers >= 0
        sizes = np.bincount(text_of[word], minlength=len(texts))
        at = np.flatnonzero(word)
        if not len(at):
            return np.zeros(0), sizes
        # A chain starts after a break and at a text's first word.
        starts = np.r_[True, (np.diff(at) > 1) | (np.diff(text_of[at]) > 0)]
        part = self.parts[numbers[at]]
        return self.chain(part[:, 0], part[:, 1], part[:, 2], starts)[0], sizes

    def chain(self, own, before, after, starts, pairs=False):
        scores = own.copy()
        inner = ~starts[1:]
        scores[1:] += before[:-1] * inner
        scores[:-1] += after[1:] * inner
        return marginals(scores, starts, self.transition, self.initial, pairs)

    def summaries(self, texts: list[str]) -> np.ndarray:
        """For each text the log odds of its most toxic word and the log of the expected toxic words."""
        out = np.full((len(texts), 2), [np.log(FLOOR), np.log(FLOOR)])
        for start, stop in slices(texts):
            p, sizes = self.scored(texts[start:stop])
            filled = np.flatnonzero(sizes > 0)
            if not len(filled):
                continue
            begins = (np.cumsum(sizes) - sizes)[filled]
            top = np.clip(np.maximum.reduceat(p, begins), FLOOR, 1 - FLOOR)
            out[start + filled, 0] = np.log(top / (1 - top))
            out[start + filled, 1] = np.log(np.add.reduceat(p, begins) + FLOOR)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.summaries(texts)
        z = self.calibration[0] + x @ self.calibration[1:]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _empty_field() -> Field:
    size = 1 << FEATURE_BITS
    return Field(np.zeros(size), np.zeros(size), np.zeros(size), 0.0, np.zeros((2, 2)), np.zeros(2))


def train(sentences: list[tuple[list[str], list[int]]], steps: int = 60) -> Field:
    """Maximise the conditional likelihood of the tags by Adam over all sentences."""
    model = _empty_field()
    if not sentences:
        return model
    size = 1 << FEATURE_BITS
    words = [w for ws, _ in sentences for w in ws]
    tags = np.array([t for _, ts in sentences for t in ts])
    lengths = np.array([len(ws) for ws, _ in sentences])
    starts = np.zeros(len(words), bool)
    starts[np.cumsum(lengths) - lengths] = True
    owner, slots = [], []
    for i, w in enumerate(words):
        found = [_slot(f) for f in word_features(w)]
        owner += [i] * len(found)
        slots += found
    owner, slots = np.array(owner), np.array(slots)
    word = np.array([_slot(f"w={w.lower()}") for w in words])
    inner = ~starts
    later = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[later - 1], tags[later]), 1)
    first = np.bincount(tags[starts], minlength=2).astype(float)
    weights = {
        "own": model.own, "before": model.before, "after": model.after, "bias": np.array(-3.0),
        "transition": model.transition, "initial": model.initial,
    }
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    for step in range(1, steps + 1):
        model.own, model.before, model.after = weights["own"], weights["before"], weights["after"]
        model.bias, model.transition, model.initial = float(weights["bias"]), weights["transition"], weights["initial"]
        own = np.bincount(owner, weights["own"][slots], len(words)) + model.bias
        p, joint = model.chain(own, weights["before"][word], weights["after"][word], starts, pairs=True)
        error = p - tags
        grads = {
            "own": np.bincount(slots, error[owner], size),
            "before": np.bincount(word[later - 1], error[later], size),
            "after": np.bincount(word[later], error[later - 1], size),
            "bias": error.sum(),
            "transition": joint.sum(axis=0) - seen,
            "initial": np.array([(1 - p[starts]).sum(), p[starts].sum()]) - first,
        }
        for k, g in grads.items():
            g = (g + (0.5 * weights[k] if k in ("own", "before", "after") else 0)) / len(sentences)
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = (m, v)
            rate = 0.25 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weights[k] = weights[k] - rate * m / (np.sqrt(v) + 1e-6)
    model.own, model.before, model.after = weights["own"], weights["before"], weights["after"]
    model.bias, model.transition, model.initial = float(weights["bias"]), weights["transition"], weights["initial"]
    return model


def calibrated(summaries: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on a document's two summaries, by Newton steps."""
    x = np.c_[np.ones(len(summaries)), summaries]
    # The sample holds both kinds about equally; a small ridge keeps separable data finite.
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-3, 1e-2, 1e-2]) * len(x) / 100
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ beta)
    return beta


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(text):
        if token in _BREAKS:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of about the bounded number of rows of each kind; chosen labels are broadcast."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out("doc_id")
    )
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE_TOXIC / max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1.0, SAMPLE_CLEAN / max(1, n.get(0, 0))))
    )
    chosen = usable.where(sample_below(F.col("doc_id"), share)).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def chance(bad: int, good: int, share: float) -> float:
    """Probability that of ``bad + good`` documents at least ``bad`` are toxic, at this share of toxic ones."""
    n = bad + good
    k = np.arange(bad, n + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    terms = logs[n] - logs[k] - logs[n - k] + k * np.log(share) + (n - k) * np.log1p(-share)
    return float(np.exp(terms).sum())


def marking_features(sample: DataFrame) -> set[str]:
    """Words and beginnings that mark tokens of toxic documents."""

    def features(text: str) -> set[str]:
        return {f for w in set(_TOKEN.findall(text)) - _BREAKS for f in word_features(w) if f[0] != "s"}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch, "text"), strict=True):
                found = features(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(found), pa.int32()), pa.array(sorted(found), pa.string())], ["toxic", "feature"]
                )

    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return set()
    counts = cut_lineage(
        sample.select("toxic", "text")
        .mapInArrow(listed, "toxic int, feature string")
        .groupBy("feature")
        .agg(F.sum("toxic").cast("int").alias("bad"), F.sum(1 - F.col("toxic")).cast("int").alias("good"))
        .where("bad > 0")
    )
    tested, share = counts.count(), total[1] / (total[0] + total[1])
    ratio = (F.col("bad") / total[1]) / ((F.col("good") + 0.5) / total[0])
    kept = counts.where((F.col("good") == 0) | (ratio >= MIN_RATIO)).withColumn("ratio", ratio)
    ranks = {
        r["feature"]: (p, -r["ratio"], r["feature"])
        for r in kept.collect()
        if (p := chance(r["bad"], r["good"], share)) <= CHANCE
    }
    marks = {f for f, (p, negative, _) in ranks.items() if p <= CHANCE / tested and -negative >= MIN_RATIO}
    known = sample.sparkSession.sparkContext.broadcast((ranks, marks))  # bounded by the sample

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, sure = known.value
        for batch in batches:
            found = []
            for text in texts_of(batch, "text"):
                here = features(text)
                if here.isdisjoint(sure) and (candidates := [ranked[f] for f in here if f in ranked]):
                    found.append(min(candidates)[2])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(found)), pa.string())], ["feature"])

    more = sample.where("toxic = 1").select("text").mapInArrow(best, "feature string").distinct()
    return marks | {r["feature"] for r in more.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field learned from the sample, with the calibration of its document scores."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, labels)
    marks = marking_features(sample)
    if not marks:
        return _empty_field()
    shared = spark.sparkContext.broadcast(frozenset(marks))  # bounded by the sample

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            toxic, words, tags, picks = [], [], [], []
            for label, text in zip(batch.column("toxic").to_pylist(), texts_of(batch, "text"), strict=True):
                for s in _sentences(text):
                    marked = [int(bool(label) and any(f in known for f in word_features(w))) for w in s]
                    pick = zlib.crc32(" ".join(s).encode("utf-8", "replace")) / 2**32
                    # Marked sentences around their marks; of the others a fixed share, so that the
                    # number of sentences stays near its bound.
                    if any(marked):
                        at = max(0, marked.index(1) - SENTENCE_TOKENS // 2)
                    elif pick < 0.08:
                        at = 0
                    else:
                        continue
                    toxic.append(label)
                    words.append(s[at : at + SENTENCE_TOKENS])
                    tags.append(marked[at : at + SENTENCE_TOKENS])
                    picks.append(pick)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32())), pa.array(picks, pa.float64())],
                ["words", "tags", "pick"],
            )

    pool = sample.select("toxic", "text").mapInArrow(tagged, "words array<string>, tags array<int>, pick double")
    rows = pool.orderBy("pick", "words").limit(SENTENCES).collect()
    model = train([(list(r["words"]), list(r["tags"])) for r in rows])
    held = spark.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = held.value.summaries(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    found = sorted(tuple(r) for r in sample.select("toxic", "text").mapInArrow(summed, "toxic int, a double, b double").collect())
    table_ = np.array(found, np.float64)
    model.calibration = calibrated(table_[:, 1:], table_[:, 0])
    return model


def score(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three tables of 2 ** FEATURE_BITS numbers

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    columns = docs.select("doc_id", held_out().alias("held_out"), "text")
    return columns.mapInArrow(told, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text, lambda texts: (shared.value.scores(texts) < threshold).tolist())


def spans_of(text: str, model: Field, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` in characters of runs of toxic words within a sentence."""
    p, _ = model.scored([text])
    spans: list[tuple[int, int, float]] = []
    at, open_ = 0, False
    for m in _TOKEN.finditer(text):
        if m[0] in _BREAKS:
            open_ = False
            continue
        if p[at] >= threshold:
            if open_:
                start, _, best = spans[-1]
                spans[-1] = (start, m.end(), max(best, float(p[at])))
            else:
                spans.append((m.start(), m.end(), float(p[at])))
            open_ = True
        else:
            open_ = False
        at += 1
    return spans


def toxic_spans(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, end, probability``: the offending places of every document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for i, text in enumerate(texts_of(batch, "text")):
                for span in spans_of(text, shared.value, threshold):
                    rows.append(i)
                    spans.append(span)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            columns += [pa.array([s[k] for s in spans], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "probability"])

    return docs.select("doc_id", "text").mapInArrow(listed, f"doc_id {kind}, start long, end long, probability double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
