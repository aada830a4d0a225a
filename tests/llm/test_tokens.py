"""Token counts and packing against the tokenizer library and plain checks."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casegraph.llm import packing, token_counts

ALPHABET = "abÀÿßªµ×÷²½ABC'se \n\t<|>endoftx019.,! ́İΣ🙂\x1c　\xa0"


def random_texts(n=1500):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def counting():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(counting):
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")).count
    for text in random_texts():
        assert count(text) == len(counting.encode(text, add_special_tokens=False).ids), text


def test_ids_equal_the_library(words):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in random_texts():
        got = np.frombuffer(encoder.ids(text), "<u4").tolist()
        assert got == words.encode(text, add_special_tokens=False).ids, text


def test_counts_of_documents(spark, documents, counting):
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(counting.encode(r["text"], add_special_tokens=False).ids)
        found = got[r["doc_id"]]
        assert (found["n_tokens"], found["over_limit"]) == (n, n > 1024)
        assert found["n_bytes"] == len(r["text"].encode())


def test_counts_of_odd_rows(odd, none, counting):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count()
    want = sorted(len(counting.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted(r["n_tokens"] for r in rows) == want
    assert token_counts.token_counts(none).count() == 0


def check_packing(docs, rows, words, capacity):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    want = []
    for doc_id, found in texts.items():
        for text in found:
            ids = words.encode(text, add_special_tokens=False).ids + [1]
            for k, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                crc = zlib.crc32(np.array(part, "<u4").tobytes())
                want.append((str(doc_id), k, start, len(part), crc))
    got = [(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_packing_of_documents(documents, words):
    used, least = check_packing(documents, packing.packed_documents(documents).collect(), words, 4096)
    assert used <= least * 1.05 + 1


def test_packing_of_odd_rows(odd, none, words):
    check_packing(odd, packing.packed_documents(odd).collect(), words, 4096)
    assert packing.packed_documents(none).count() == 0


def test_packing_in_several_groups(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.pack(items, capacity=100, group_items=200).collect()
    assert sorted(r["item"] for r in rows) == list(range(3000))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["item"]]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 100
    assert len(sequences) <= 1.12 * sum(lengths) / 100  # groups of 200 items waste more than full ones


def plain_place(lengths, capacity):
    """The rule written out: try every bin, take the smallest sum of squares, then the smallest gap."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for b, gap in [*enumerate(gaps), (len(gaps), capacity)]:
            if gap >= s:
                after = gaps[:b] + [gap - s] + gaps[b + 1 :]
                counts = np.bincount([g for g in after if g], minlength=capacity + 1)
                key = (int((counts**2).sum()), gap)
                if best is None or key < best[0]:
                    best = (key, b, gap)
        _, b, gap = best
        gaps = gaps[:b] + [gap - s] + gaps[b + 1 :]
        out.append(capacity - gap)
    return out, len(gaps)


def test_rule_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(2, 13))
        lengths = rng.integers(1, capacity + 1, 25)
        bins, offsets = packing.place(lengths, capacity)
        want, n = plain_place(lengths.tolist(), capacity)
        assert offsets.tolist() == want and bins.max() + 1 == n
