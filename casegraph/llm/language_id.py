"""Language identification with a small convolutional network over bytes.

A text's bytes are cut into windows of fixed length, padded with zeros.  Each byte is embedded, filters
of several widths slide over the window, the largest response of each filter is kept, and a softmax
layer gives the language.  A document's probabilities are the means over its windows, weighted by
their bytes, so whole texts count.  The network is trained in numpy by Adam on windows of labelled
documents; the batches of windows are single matrix products.

The training sample is bounded: about ``PER_LANGUAGE`` documents of each language, ``WINDOWS_EACH``
windows of each.  Rows whose id is held out, and rows without a language, are never learned from.

Defined results: a null text, and one without any letter, is ``und`` with score 1; without any
labelled row every text is ``und`` with score 0; repeated rows stay; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, held_out, kept_rows, sample_below, table, texts_of

WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 8
PER_LANGUAGE = 1000
WINDOWS_EACH = 3
EPOCHS = 5
UNKNOWN = "und"
#: Below this score a filter takes a text to be in no known language.
MIN_SCORE = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_SPAN = max(WIDTHS)
#: Windows of one matrix product; the patches of so many bytes stay in the cache.
_AT_ONCE = 64


@dataclass
class ByteNet:
    """Weights of the network; filters of all widths share one kernel of the largest width."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    kernel: np.ndarray  # _SPAN * EMBEDDING x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        """Ones where a filter of a width sees a byte."""
        mask = np.zeros((_SPAN, EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
        for i, width in enumerate(WIDTHS):
            mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        return mask.reshape(_SPAN * EMBEDDING, -1)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """``windows`` (n x WINDOW bytes) as n * WINDOW rows of embedded neighbouring bytes."""
        n = len(windows)
        padded = np.zeros((n, WINDOW + _SPAN - 1), np.uint8)
        padded[:, :WINDOW] = windows
        embedded = self.embedding[padded]
        row, column, item = embedded.strides
        view = np.lib.stride_tricks.as_strided(
            embedded, (n, WINDOW, _SPAN * EMBEDDING), (row, column, item), writeable=False
        )
        return np.ascontiguousarray(view).reshape(n * WINDOW, -1)

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, before the threshold, and all responses."""
        responses = (self.patches(windows) @ self.kernel).reshape(len(windows), WINDOW, -1)
        return responses.max(axis=1) + self.bias, responses

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), _AT_ONCE):
            top, _ = self.hidden(windows[i : i + _AT_ONCE])
            logits = np.maximum(top, 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            parts.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> ByteNet:
    """Fit the network by Adam; the same input gives the same weights."""
    rng = np.random.default_rng(7)
    filters = len(WIDTHS) * FILTERS
    mask = ByteNet.mask()
    net = ByteNet(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, (_SPAN * EMBEDDING, filters)) * mask).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.3, (filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    names = ("embedding", "kernel", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    # Every language weighs the same, however many windows it has.
    share = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    weight = (len(labels) / (len(languages) * np.maximum(share, 1)))[labels]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            batch, want = windows[pick], labels[pick]
            top, responses = net.hidden(batch)
            active = np.maximum(top, 0)
            logits = active @ net.out + net.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), want] -= 1
            p *= (weight[pick] / len(pick))[:, None]
            grads = {"out": active.T @ p, "out_bias": p.sum(axis=0)}
            back = (p @ net.out.T) * (top > 0)
            grads["bias"] = back.sum(axis=0)
            # Only the place of the largest response gets a gradient.
            place = responses.argmax(axis=1)
            padded = np.zeros((len(pick), WINDOW + _SPAN - 1), np.uint8)
            padded[:, :WINDOW] = batch
            seen = padded[np.arange(len(pick))[:, None, None], place[:, :, None] + np.arange(_SPAN)]
            patch = net.embedding[seen].reshape(len(pick), filters, -1)
            grads["kernel"] = np.einsum("nf,nfk->kf", back, patch) * mask
            spread = (back[:, :, None] * net.kernel.T[None]).reshape(-1, EMBEDDING)
            grads["embedding"] = np.stack(
                [np.bincount(seen.ravel(), spread[:, d], 256) for d in range(EMBEDDING)], axis=1
            )
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                value = getattr(net, k) - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
                setattr(net, k, value.astype(np.float32))
    return net


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteNet | None:
    """The network learned from the rows that are not held out; None if there are none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id).alias("held")
    ).where("not held and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    pairs = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n)))]
    share = F.element_at(F.create_map(*pairs), F.col("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for name, body in zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
                if not _LETTER.search(body):
                    continue
                all_ = windows_of(body.encode("utf-8", "replace"))
                for i in sorted({k * len(all_) // WINDOWS_EACH for k in range(WINDOWS_EACH)}):
                    langs.append(name)
                    found.append(all_[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "bytes"])

    sample = known.where(sample_below(F.col("doc_id"), share)).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in sample.mapInArrow(cut, "lang string, bytes binary").collect())
    if not rows:
        return None
    languages = sorted({name for name, _ in rows})
    index = {name: i for i, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([index[name] for name, _ in rows]), languages)


def predict(net: ByteNet | None, texts: list[str]) -> list[tuple[str, float]]:
    """``(language, score)`` of every text."""
    out: list[tuple[str, float]] = []
    for body in texts:
        if not _LETTER.search(body):
            out.append((UNKNOWN, 1.0))
        elif net is None:
            out.append((UNKNOWN, 0.0))
        else:
            data = body.encode("utf-8", "replace")
            windows = windows_of(data)
            weight = np.full(len(windows), WINDOW, np.float64)
            weight[-1] = len(data) - WINDOW * (len(windows) - 1)
            p = weight @ net.probabilities(windows) / len(data)
            best = int(p.argmax())
            out.append((net.languages[best], float(min(1.0, p[best]))))
    return out


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some KB

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(shared.value, texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    columns = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return columns.mapInArrow(told, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteNet | None, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows whose text has a recognised language: not ``und`` and at least the given score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def keep(texts: list[str]) -> list[bool]:
        return [name != UNKNOWN and score >= least for name, score in predict(shared.value, texts)]

    return kept_rows(docs, text, keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
