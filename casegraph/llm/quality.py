"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: every word (a hash bucket of a token) has a fixed sparse vector of -1, 0 and 1.  One
pass over all texts adds, for every occurrence of a word, the index vectors of its neighbours to the
word's context vector.  Each task adds up its own table of fixed size; tables are summed in Spark in
row ranges.  A document is pooled to the mean and the spread of its words' vectors, how alike
neighbouring words are, and its length.  A two-layer network in numpy gives the score; a temperature
fitted on rows set aside from training makes its probabilities honest.

The network is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` on average) whose ids are
not held out; the word vectors come from all texts and no label, language, source or id.

Defined results: a null or empty text has the pooled vector of no words and is scored like any other;
without labels of both kinds every score is the share of label 1 (0.5 without any label); repeated
rows stay; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, held_out, sample_below, slices, table, texts_of

BUCKETS = 8192
DIMENSIONS = 32
NONZERO = 6
REACH = 2
HIDDEN = 24
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
#: Rows of one range of the context table.
RANGE = 1024
MEMO_WORDS = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
FEATURES = 2 * DIMENSIONS + 4


def index_vectors() -> np.ndarray:
    """The fixed sparse vectors of all buckets."""
    rng = np.random.default_rng(42)
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))
    np.put_along_axis(vectors, places, signs, axis=1)
    return vectors


class Buckets(dict):
    """Hash bucket of a token; a memo of bounded size."""

    def __missing__(self, token: str) -> int:
        bucket = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[token] = bucket
        return bucket


_BUCKETS = Buckets()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens, and the number of tokens of each text."""
    split = [_TOKEN.findall(t) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    known = _BUCKETS
    ids = np.fromiter((known[t] for s in split for t in s), np.int64, int(sizes.sum()))
    return ids, sizes


def context_sums(texts: list[str], index: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the index vectors of its neighbours in these texts."""
    total = np.zeros((BUCKETS, DIMENSIONS))
    for start, stop in slices(texts):
        ids, sizes = words(texts[start:stop])
        if not len(ids):
            continue
        near = np.zeros((len(ids), DIMENSIONS), np.float32)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        for k in range(1, REACH + 1):
            same = (text_of[k:] == text_of[:-k])[:, None]
            near[k:] += index[ids[:-k]] * same
            near[:-k] += index[ids[k:]] * same
        for d in range(DIMENSIONS):
            total[:, d] += np.bincount(ids, near[:, d], BUCKETS)
    return total


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all texts, each of length one (zero where unseen)."""
    bounded_batches(docs.sparkSession)
    ranges = BUCKETS // RANGE

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIMENSIONS))
        for batch in batches:
            total += context_sums(texts_of(batch, "text"), index)
        parts = [total[i * RANGE : (i + 1) * RANGE].tobytes() for i in range(ranges)]
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(parts, pa.binary())], ["range", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in frame["sums"])
        return pd.DataFrame({"range": frame["range"].iloc[:1], "salt": [0], "sums": [total.tobytes()]})

    # Two steps, so that one task never reads the tables of all tasks.
    fields = "range int, salt int, sums binary"
    tables = docs.select(F.col(text).alias("text")).mapInArrow(summed, "range int, sums binary")
    salted = tables.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    partial = salted.groupBy("range", "salt").applyInPandas(added, fields)
    rows = partial.groupBy("range").applyInPandas(added, fields).collect()
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    for r in rows:
        vectors[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(r["sums"]).reshape(RANGE, DIMENSIONS)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for start, stop in slices(texts):
        ids, sizes = words(texts[start:stop])
        n = len(sizes)
        text_of = np.repeat(np.arange(n), sizes)
        seen = vectors[ids]
        count = np.maximum(sizes, 1)[:, None]
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        filled = sizes > 0

        def sums(values: np.ndarray, filled=filled, begins=begins, n=n) -> np.ndarray:
            total = np.zeros((n, *values.shape[1:]))
            if filled.any():
                total[filled] = np.add.reduceat(values, begins[filled], axis=0, dtype=np.float64)
            return total

        mean = sums(seen) / count
        spread = np.sqrt(np.maximum(sums(seen * seen) / count - mean**2, 0))
        alike, equal = np.zeros(len(ids)), np.zeros(len(ids))
        if len(ids) > 1:
            same = text_of[1:] == text_of[:-1]
            alike[1:] = np.einsum("ij,ij->i", seen[1:], seen[:-1]) * same
            equal[1:] = (ids[1:] == ids[:-1]) & same
        part = out[start:stop]
        part[:, :DIMENSIONS], part[:, DIMENSIONS : 2 * DIMENSIONS] = mean, spread
        part[:, -4] = sums(alike) / count[:, 0]
        part[:, -3] = sums(equal) / count[:, 0]
        part[:, -2] = np.linalg.norm(mean, axis=1)
        part[:, -1] = np.log1p(sizes) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of the logit."""

    center: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.center) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -60, 60)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def train(features: np.ndarray, labels: np.ndarray, epochs: int = 40) -> Network:
    """Fit the layers on four fifths of the rows and the temperature on the rest."""
    rng = np.random.default_rng(5)
    n = features.shape[1]
    order = rng.permutation(len(features))
    aside, rows = order[: len(order) // 5], order[len(order) // 5 :]
    share = float(np.clip(labels.mean(), 0.001, 0.999)) if len(labels) else 0.5
    net = Network(
        features.mean(axis=0) if len(features) else np.zeros(n),
        features.std(axis=0) + 1e-3 if len(features) else np.ones(n),
        rng.normal(0, n**-0.5, (n, HIDDEN)),
        np.zeros(HIDDEN),
        np.zeros(HIDDEN),
        float(np.log(share / (1 - share))),
    )
    if len(set(labels.tolist())) < 2:
        return net
    net.second = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    scaled = (features - net.center) / net.scale
    weights = [net.first, net.first_bias, net.second, np.array(net.second_bias)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        for at in range(0, len(rows), 128):
            pick = rows[at : at + 128]
            x, y = scaled[pick], labels[pick]
            hidden = np.tanh(x @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -60, 60))) - y) / len(pick)
            back = error[:, None] * weights[2] * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * weights[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                m, v = moments[i]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                moments[i] = (m, v)
                rate = 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * m / (np.sqrt(v) + 1e-8)
        rows = rng.permutation(rows)
    net.first, net.first_bias, net.second, net.second_bias = weights[0], weights[1], weights[2], float(weights[3])
    logits = net.logits(features[aside])
    tried = np.geomspace(0.25, 8, 61)
    net.temperature = float(min(tried, key=lambda t: _loss(logits / t, labels[aside]))) if len(aside) else 1.0
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label`` of about ``rows`` labelled rows that are not held out.

    The chosen labels (two numbers a row) are bounded by ``rows`` and so are broadcast.
    """
    usable = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & ~held_out("doc_id"))
    total = usable.count()
    chosen = usable.where(sample_below(F.col("doc_id"), min(1.0, rows / max(total, 1))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Word vectors of all texts, and the network learned from the sample of labelled rows."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS floats

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled(texts_of(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "features"]
            )

    sample = labelled_sample(docs, labels, label).select(F.col("label").cast("int").alias("label"), "text")
    rows = sorted((bytes(r["features"]), r["label"]) for r in sample.mapInArrow(featured, "label int, features binary").collect())
    features = np.frombuffer(b"".join(f for f, _ in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return QualityModel(vectors, train(features, np.array([y for _, y in rows], np.float64)))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

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


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
