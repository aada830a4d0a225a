"""Removal of repeated substrings against every string of every text."""

import random
from hashlib import sha256

import numpy as np
import pytest

from casegraph.llm import suffix_dedup
from casegraph.llm.suffix_dedup import removed_repeats

EMPTY = sha256(b"").hexdigest()


def plain(rows, window=suffix_dedup.WINDOW):
    """The results by a map from each string to the smallest id of a document that has it."""
    last = 1 << 63
    rows = [(last if i is None else i, (t or "").encode(), i) for i, t in rows]
    first = {}
    for i, body, _ in rows:
        for p in range(len(body) - window + 1):
            w = body[p : p + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, body, own in rows:
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - window + 1):
            if first[body[p : p + window]] < i:
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
        out.append((own, len(body), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in columns) for r in removed_repeats(df).collect()), key=str)


def test_cover_has_every_difference():
    cover, period = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = got(documents)
    assert found == plain(rows)
    assert any(0 < r[2] < r[1] for r in found)


@pytest.mark.parametrize("pieces", [False, True])
def test_shifted_passages(spark, monkeypatch, pieces):
    """Passages of 48 to 60 bytes at all offsets, many copies, runs in one text, ids out of order, long texts in pieces."""
    if pieces:
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 70)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in range(44, 62)]
    rows = []
    for i in rng.sample(range(-200, 400), 150):
        parts = [text(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), text(rng.randrange(30))]
        rows.append((i, "".join(parts)))
    rows += [(500 + k, "z" * (40 + k)) for k in range(25)] + [(None, "z" * 60), (None, passages[-1]), (7, "z" * 55), (7, "z" * 55)]
    rows += [(rows[0][0], rows[3][1]), (1000, rows[5][1]), (1001, rows[5][1]), (1002, ""), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if not pieces:
        assert got(df) == plain(rows)
        return
    # Workers do not see the patched sizes, so the steps between the shuffles run here.
    assert plain(rows) == _in_pieces(rows)


def _in_pieces(rows):
    """The operator's own steps without Spark, over small pieces and blocks."""
    import pyarrow as pa

    from casegraph.llm import blobs

    firsts = {}
    for i, t in rows:
        body = (t or "").encode()
        firsts[body] = min(firsts.get(body, suffix_dedup.NO_ID), suffix_dedup.NO_ID if i is None else i)
    texts = list(firsts)
    batch = pa.table({"k1": range(len(texts)), "k2": [0] * len(texts), "doc": [firsts[t] for t in texts], "text": [t.decode() for t in texts]})
    import unittest.mock as mock

    with mock.patch.object(suffix_dedup, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        made = [suffix_dedup.Block.of(b, 0) for b in suffix_dedup._blocks(batch.to_batches())]
    parts = 3

    def exchange(asked, answer):
        told = {i: [] for i in range(len(made))}
        for part in range(parts):
            rows = [(i, q) for i, p, q in asked if p == part]
            if rows:
                for (i, _), said in zip(rows, answer([q for _, q in rows]), strict=True):
                    if said is not None:
                        told[i].append({"part": part, "answer": said})
        return told

    def asked(encode):
        return [(r["block"], r["part"], r["asked"]) for i, b in enumerate(made) for q in encode(i, b) for r in q.to_pylist()]

    def sampled(i, b):
        _, _, part, name, many = b.samples(parts)
        return blobs.asked_rows(i, part, lambda x, y: blobs.joined(blobs.ascending(name[x:y]), np.packbits(many[x:y]).tobytes()))

    shared = exchange(asked(sampled), suffix_dedup._recurring)

    def tied(i, b):
        _, _, part, name, low = b.ties(parts, shared[i])

        def coded(x, y):
            ids = b.ids.view(np.uint64) ^ np.uint64(1 << 63)
            return blobs.joined(blobs.ascending(name[x:y]), blobs.ascending(ids), blobs.squeezed(low[x:y].astype(np.uint32)))

        return blobs.asked_rows(i, part, coded)

    yielding = exchange(asked(tied), suffix_dedup._yielding)
    results, cut = {}, []
    for i, b in enumerate(made):
        for k1, k2, start, n, spans, kept, own, runs in suffix_dedup._finished(b, b.removed(parts, shared[i], yielding[i])):
            if own is None:
                results[k1] = (n, spans, kept)
            else:
                cut.append((k1, k2, start, own, runs))
    assert len(cut) > 200
    cut.sort(key=lambda r: r[:3])
    table = pa.table(dict(zip(("k1", "k2", "start", "own", "runs"), zip(*cut, strict=True), strict=True)))
    for r in suffix_dedup._long_documents(table.to_batches(max_chunksize=7)):
        for one in r.to_pylist():
            results[one["k1"]] = (one["n_removed"], one["n_spans"], one["kept_sha256"])
    out = []
    for i, t in rows:
        body = (t or "").encode()
        result = results[texts.index(body)]
        if (suffix_dedup.NO_ID if i is None else i) > firsts[body] and len(body) >= 50:
            result = (len(body), 1, EMPTY)
        out.append((i, len(body), *result))
    return sorted(out, key=str)


def test_odd_rows(spark, odd, none):
    found = got(odd)
    assert len(found) == odd.count()
    assert [r[2] for r in found if r[0] is None] == [0, 0]
    long = next(r for r in found if r[0] == 6)
    assert long[1] > suffix_dedup.PIECE_BYTES and long[2:] == (0, 0, sha256(next(r["text"] for r in odd.collect() if r["doc_id"] == 6).encode()).hexdigest())
    assert removed_repeats(none).count() == 0


def test_a_long_text_and_its_parts(spark, odd):
    """A text of several pieces that repeats, shifted, in a later one."""
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefghij") for _ in range(2 * suffix_dedup.PIECE_BYTES + 49))
    df = spark.createDataFrame([(1, body), (2, "xy" + body[1000:] + "yx" + body[:40]), (3, "q" + body)], "doc_id long, text string")
    n = len(body)
    kept = ["", "xyyx" + body[:40], "q"]
    assert [r[1:4] for r in got(df)] == [(n, 0, 0), (n - 956, n - 1000, 1), (n + 1, n, 1)]
    assert [r[4] for r in got(df)] == [sha256(x.encode()).hexdigest() for x in [body, *kept[1:]]]


def test_keys_are_sorted_with_their_places():
    """Also keys that differ only in the bits that hold the places, equal keys, and few or none."""
    from casegraph.llm import blobs

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000):
        for low, shift in ((1 << 63, 0), (8, 0), (8, 60), (1 << 32, 32), (1, 0)):
            keys = rng.integers(0, low, n).astype(np.uint64) << np.uint64(shift)
            order, ranked = blobs.sorted_with_places(keys)
            assert order.tolist() == np.argsort(keys, kind="stable").tolist()
            assert (ranked == keys[order]).all()


def _block(texts):
    """The block of some texts, whose ids are their places."""
    import unittest.mock as mock

    import pyarrow as pa

    n = len(texts)
    batch = pa.table({"k1": range(n), "k2": [0] * n, "doc": range(n), "text": texts})
    with mock.patch.object(suffix_dedup, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        (made,) = suffix_dedup._blocks(batch.to_batches())
    return suffix_dedup.Block.of(made, 0)


def test_samples_take_no_longer_than_to_sort_them_once():
    """A block's samples are named and grouped faster than their names would be sorted by place alone."""
    import time

    rng = random.Random(5)
    block = _block(["".join(rng.choices("abcdefghijklmnop ", k=3000)) for _ in range(1100)])

    def took(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    names = np.random.default_rng(6).integers(0, 1 << 63, len(block.samples(64)[0])).astype(np.uint64)
    once = min(took(lambda: np.argsort(names, kind="stable")) for _ in range(5))
    assert min(took(lambda: block.samples(64)) for _ in range(5)) < 1.5 * once


def test_block_of_empty_texts():
    block = _block(["", None, ""])
    gone = block.removed(64, None, None)
    assert [r[3:6] for r in suffix_dedup._finished(block, gone)] == [(0, 0, EMPTY)] * 3


def test_answers_by_slices(monkeypatch):
    """A part that is answered in several slices gives the same bits as in one."""
    from casegraph.llm import blobs

    rng = np.random.default_rng(7)
    few = [np.sort(rng.choice(1 << 31, 300)).astype(np.uint32) * np.uint32(2) for _ in range(4)]
    few = [np.unique(np.r_[n, few[0][: 50 * i]]) for i, n in enumerate(few)] + [np.array([few[0][0], (1 << 32) - 1], np.uint32)]
    asked = [blobs.joined(blobs.ascending(n), np.packbits(n % 10 == 0).tobytes()) for n in few]
    ids = np.arange(3, dtype=np.uint64)
    ties = [n.astype(np.uint64) << np.uint64(32) for n in few]
    dealt = [
        blobs.joined(blobs.ascending(n), blobs.ascending(ids + np.uint64(i % 2)), blobs.squeezed(rng.integers(0, 3, len(n)).astype(np.uint32)))
        for i, n in enumerate(ties)
    ]
    plain = suffix_dedup._recurring(asked), suffix_dedup._yielding(dealt)
    held = [set(n.tolist()) for n in few]
    for i, (n, bits) in enumerate(zip(few, plain[0])):
        wanted = [x % 10 == 0 or sum(x in h for h in held) > 1 for x in n.tolist()]
        assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(n)).tolist() == wanted
    assert any(plain[1])
    monkeypatch.setattr(blobs, "KEYS_A_PART", 37)
    assert (suffix_dedup._recurring(asked), suffix_dedup._yielding(dealt)) == plain
