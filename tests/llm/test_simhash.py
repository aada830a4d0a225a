"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casegraph.llm import simhash


def plain_fingerprint(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=3):
    """The smallest id reachable from each (id, fingerprint), by union over all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fp = np.array([p for _, p in prints], np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i:] ^ fp[i]) <= distance) + i:
            parent[find(int(j))] = find(i)
    low = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return [low.get(find(i)) for i in range(len(prints))]


def test_fingerprint_is_the_plain_one():
    for text in ("", " \x0b\n", "One", "one TWO", "Ä b c d é f", "a b c d e f g a b c d", "x " * 500):
        for k in (3, 5):
            assert simhash.fingerprint(text, k) == plain_fingerprint(text, k)


def test_documents(spark, documents):
    rows = simhash.near_duplicates(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = [(r["doc_id"], plain_fingerprint(texts[r["doc_id"]])) for r in rows]
    assert len(rows) == len(texts)
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for _, p in prints]
    assert [r["component_id"] for r in rows] == components(prints)


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert of[(1, "0" * 16)] == of[(2, "0" * 16)] == of[(3, "0" * 16)] == 1
    assert {c for (i, _), c in of.items() if i in (4, 5)} == {4}
    assert {c for (i, _), c in of.items() if i is None} == {None}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    dense = rng.getrandbits(64)  # a crowded cell: many fingerprints around one
    for _ in range(150):
        prints.add(dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    for p in list(prints)[:100]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = [(r["src"], r["dst"]) for r in simhash.links(df, block=block).collect()]
    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    index = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(signed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(index[a])] = find(index[b])
    want = components([(i, p & (1 << 64) - 1) for i, p in enumerate(signed)])
    got = [find(i) for i in range(len(signed))]
    assert len({(g, w) for g, w in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    embedded = df.select("a", "b", simhash.embed(F.col("a")).alias("ea"), simhash.embed(F.col("b")).alias("eb"))
    for r in embedded.collect():
        counts = [[(x >> 2 * i & 3).bit_count() for i in range(32)] for x in (r["a"], r["b"])]
        manhattan = sum(abs(p - q) for p, q in zip(*counts, strict=True))
        assert ((r["ea"] ^ r["eb"]) & (1 << 64) - 1).bit_count() == manhattan
        assert manhattan <= (r["a"] ^ r["b"]).bit_count()


def test_one_row_of_each_group(odd, none, documents):
    rows = simhash.one_per_group(odd).collect()
    assert simhash.one_per_group(odd).columns == odd.columns
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 4, 6, 7, 8, 9, None], key=str)
    assert simhash.one_per_group(none).count() == 0
    kept = {r["doc_id"] for r in simhash.one_per_group(documents).collect()}
    prints = [(r["doc_id"], plain_fingerprint(r["text"], 5)) for r in documents.collect()]
    assert kept == set(components(prints))
