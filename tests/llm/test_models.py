"""Language, quality and toxicity: held-out accuracy, exact inference, defined results of odd rows."""

import itertools

import numpy as np
import pytest

from casegraph.llm import language_id, quality, toxicity
from casegraph.llm.crf import marginals


@pytest.fixture(scope="session")
def big(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def area(labels, scores):
    labels, scores = np.array(labels), np.array(scores)
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()).item()


def test_language(big, odd, none):
    docs, _ = big
    net = language_id.fit(docs)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.identify(docs, net).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 100 < len(held) < 300
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, net).collect()}
    assert got[1] == got[2] == got[3] == got[7] == "und" and got[6] in net.languages
    assert language_id.identify(none, net).count() == 0
    kept = language_id.keep_identified(odd, net)
    assert kept.columns == odd.columns and not {1, 2, 3, 7} & {r["doc_id"] for r in kept.collect()}
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_gradient_of_the_byte_network():
    """Training lowers the loss on an easy task to nothing."""
    rng = np.random.default_rng(0)
    rows = np.zeros((400, language_id.WINDOW), np.uint8)
    labels = rng.integers(0, 2, 400)
    rows[labels == 0] = rng.integers(97, 105, (int((labels == 0).sum()), language_id.WINDOW))
    rows[labels == 1] = rng.integers(103, 112, (int((labels == 1).sum()), language_id.WINDOW))
    net = language_id.train(rows, labels, ["a", "b"], epochs=4)
    assert (net.probabilities(rows).argmax(axis=1) == labels).mean() > 0.99


def test_quality(big, odd, none):
    docs, labels = big
    model = quality.fit(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score(docs, model).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert area([truth[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    odd_rows = quality.score(odd, model).collect()
    assert len(odd_rows) == odd.count()
    assert len({r["score"] for r in odd_rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(none, model).count() == 0
    unlabelled = quality.fit(odd, labels.where("false"))
    assert {round(r["score"], 6) for r in quality.score(odd, unlabelled).collect()} == {0.5}


def test_context_sums_are_those_of_neighbours():
    index = quality.index_vectors()
    texts = ["a b c d", "c a", ""]
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for t in texts:
        ids = [quality._BUCKETS[w] for w in t.split()]
        for i, j in itertools.permutations(range(len(ids)), 2):
            if abs(i - j) <= quality.REACH:
                want[ids[i]] += index[ids[j]]
    assert np.allclose(quality.context_sums(texts, index), want)


def test_marginals_against_all_tag_sequences():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 10))
        scores, starts = rng.normal(0, 2, n), rng.random(n) < 0.3
        starts[0] = True
        moves, initial = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
        one, joint = marginals(scores, starts, moves, initial, pairs=True)
        total, want, want_joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            z = sum(
                scores[t] * tags[t] + (initial[tags[t]] if starts[t] else moves[tags[t - 1], tags[t]]) for t in range(n)
            )
            w = np.exp(z)
            total += w
            for t in range(n):
                want[t] += w * tags[t]
                if not starts[t]:
                    want_joint[t, tags[t - 1], tags[t]] += w
        assert np.allclose(one, want / total) and np.allclose(joint, want_joint / total)


def test_toxicity(big, odd, none):
    docs, labels = big
    model = toxicity.fit(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    # Few labelled documents: the other languages' words are too rare here to be learned.
    right = [truth[r["doc_id"]] == r["predicted"] for r in held]
    assert np.mean(right) > 0.93 and not any(r["predicted"] > truth[r["doc_id"]] for r in held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    odd_rows = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert max(odd_rows[i] for i in (1, 2, 3)) == pytest.approx(min(odd_rows.values()))
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = toxicity.toxic_spans(docs, model).collect()
    assert spans and all(texts[r["doc_id"]][r["start"] : r["end"]].strip() for r in spans)
    words = {texts[r["doc_id"]][r["start"] : r["end"]].lower() for r in spans}
    assert "idiot" in words
    empty = toxicity.fit(odd, labels.where("false"))
    assert max(r["score"] for r in toxicity.score(odd, empty).collect()) < 1e-6


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_toxic_words_of_few_labelled_documents(spark, size):
    """However few rows are labelled, most toxic documents that were learned from are found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    learned = [r["predicted"] for r in rows if not r["held_out"] and truth.get(r["doc_id"]) == 1]
    clean = [r["predicted"] for r in rows if truth.get(r["doc_id"]) == 0]
    assert len(learned) >= 10 and np.mean(learned) >= 0.85 and np.mean(clean) <= 0.02


def test_chance_is_the_binomial_tail():
    assert toxicity.chance(2, 0, 0.1) == pytest.approx(0.01)
    assert toxicity.chance(1, 1, 0.5) == pytest.approx(0.75)
    assert toxicity.chance(0, 3, 0.2) == pytest.approx(1.0)
