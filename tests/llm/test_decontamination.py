"""Leaks of benchmark items against a search of all shingles, and paraphrases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from casegraph.llm import decontamination as D


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, spark.read.parquet(f"{folder}/benchmark.parquet"), D.fit(docs)


def brute(docs, benchmark, share):
    """Pairs where so much of an item's five-word shingles stands in the document."""
    items = {r["item_id"]: D.words_of(r["text"]) for r in benchmark.collect()}
    out = set()
    for r in docs.collect():
        words = D.words_of(r["text"] or "")
        have = set(zip(*[words[k:] for k in range(5)], strict=False))
        for i, w in items.items():
            want = list(zip(*[w[k:] for k in range(5)], strict=False))
            if want and sum(s in have for s in want) >= share * len(want):
                out.add((r["doc_id"], i))
    return out


def test_documents(fitted):
    docs, benchmark, space = fitted
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, benchmark, space).collect()}
    assert brute(docs, benchmark, 0.8) <= got
    assert got <= brute(docs, benchmark, 0.2)
    kept = D.keep_unleaked(docs, benchmark, space)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


def test_blocks_of_items_give_the_same(fitted, monkeypatch):
    docs, benchmark, space = fitted
    want = sorted(tuple(r) for r in D.leaks(docs, benchmark, space).collect())
    monkeypatch.setattr(D.searchers, "__defaults__", (7,))
    assert sorted(tuple(r) for r in D.leaks(docs, benchmark, space).collect()) == want


def test_paraphrases(fitted):
    docs, benchmark, space = fitted
    rng = random.Random(3)
    hosts = [D.words_of(r["text"]) for r in docs.limit(100).collect()]
    spare = [w for h in hosts for w in h]
    items = benchmark.collect()
    search = D.Searcher(space, [p for r in items for p in D.pieces_of(r["item_id"], r["text"])])
    for changed, least in ((0.0, 1.0), (0.1, 0.95)):
        found = []
        for r in items:
            words = [rng.choice(spare) if rng.random() < changed else w for w in D.words_of(r["text"])]
            host = rng.choice(hosts)
            k = rng.randrange(len(host) + 1)
            text = " ".join(host[:k] + words + host[k:])
            found.append(r["item_id"] in search.leaks(pa.array([text]))[0])
        assert np.mean(found) >= least


def test_odd_rows(spark, fitted, odd, none):
    _, benchmark, space = fitted
    assert D.leaks(odd, benchmark, space).count() == 0
    assert D.leaks(none, benchmark, space).count() == 0
    assert D.leaks(odd, benchmark.where("false"), space).count() == 0
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one"), (4, "the same long item of ten words stands here twice"),
         (5, "the same long item of ten words stands here twice")], "item_id long, text string"
    )
    docs = spark.createDataFrame(
        [(1, "before it. The same long item of ten words stands here twice, and after", "x"), (1, None, "x")],
        "doc_id long, text string, item_id string",
    )
    got = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs, items, D.fit(docs)).collect())
    assert got == [(1, 4), (1, 5)]
    assert D.fit(none).projection.shape[0] == D.TERMS


def test_long_items_are_searched_by_pieces():
    words = [f"w{i}" for i in range(250)]
    pieces = D.pieces_of(9, " ".join(words))
    assert [w for p in pieces for w in p.words] == words and all(p.item == 9 for p in pieces)


def test_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(a, b) == table[-1][-1]


def test_gram_sketch_is_the_product_of_the_matrix():
    """Against the full matrix of the same passages."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"t{i % 6}x{k}" for k in range(30)], D.PASSAGE)) for i in range(120)]
    words = D.split(pa.array(texts), D.TERM_BITS)
    counts, gram = np.zeros((D.TERMS, 2)), np.zeros((D.TERMS, D.SKETCH))
    D.passage_frequencies(words, counts)
    assert counts[-1, 1] == 120
    rows = words.terms.reshape(120, D.PASSAGE)
    assert np.array_equal(counts[:, 0], sum(np.bincount(np.unique(r), minlength=D.TERMS) for r in rows))
    idf = np.log(121 / (counts[:, 0] + 1)) + 0.05
    D.gram_sketch(words, idf, gram)
    matrix = np.zeros((120, D.TERMS))
    for i, r in enumerate(rows):
        np.add.at(matrix[i], r, 1)
    matrix *= idf
    column, sign = D.test_matrix()
    test = np.zeros((D.TERMS, D.SKETCH))
    test[np.arange(D.TERMS), column] = sign
    sketch = matrix @ test
    want = (matrix / idf).T @ (sketch / (sketch**2).sum(axis=1, keepdims=True))
    assert np.allclose(gram, want)


def test_words_of_bytes():
    texts = ["One two,one", None, "", "é-É x_1", "two", "a" * 3_000_000 + " two"]
    words = D.split(pa.array(texts), 14)
    assert words.counts.tolist() == [3, 0, 0, 3, 1, 2]
    assert words.terms[0] == words.terms[2] and words.terms[1] == words.terms[6] == words.terms[8]
    assert words.text(1, 3) == "two,one" and words.text(6, 7) == "two"
    sliced = D.split(pa.array(texts).slice(3, 2), 14)
    assert np.array_equal(sliced.terms, words.terms[3:7])
    assert D.split(pa.array([], pa.string()), 14).counts.tolist() == []
    many = [f"word{i} other{i % 7}" for i in range(60_000)]
    whole = D.split(pa.array([" ".join(many)]), 14)
    assert np.array_equal(whole.terms, D.split(pa.array(many), 14).terms)


VARIANTS = {
    "no-break spaces": lambda ws: "\u00a0".join(ws),
    "curly quotes": lambda ws: " ".join(f"\u201c{w}\u201d" for w in ws),
    "dashes": lambda ws: "\u2014".join(ws),
    "capitals": lambda ws: " ".join(ws).upper(),
}
HINDI = "\u092f\u0939 \u090f\u0915 \u0932\u0902\u092c\u093e \u092a\u094d\u0930\u0936\u094d\u0928 \u0939\u0948 \u0964 \u0907\u0938\u0915\u093e \u0909\u0924\u094d\u0924\u0930 \u0915\u094c\u0928 \u0926\u0947\u0917\u093e"
CHINESE = "\u8fd9\u662f\u4e00\uff0c\u95ee\u9898\u4e8c\u3002\u7b54\u6848\u4e09\uff0c\u57fa\u51c6\u56db\u3001\u6587\u672c\u4e94\uff1b\u8bad\u7ec3\u516d\uff1a\u6570\u636e\u4e03\uff01\u6a21\u578b\u516b\uff1f\u7ed3\u679c\u4e5d"
ACCENTS = "\u00e9t\u00e9 \u00e0 l\u2019\u00e9cole o\u00f9 na\u00efve \u00e2me gar\u00e7on d\u00e9j\u00e0 \u00f6ffnet \u00fcber \u00e9l\u00e8ve"


def test_words_are_those_of_the_pieces():
    """One word definition for documents and benchmark pieces, also in blanks, quotes and case outside ASCII."""
    for text in (HINDI, CHINESE, ACCENTS, ACCENTS.upper(), "a\u00a0b \u201cc\u201d d\u2026e", "\u0130x \u1e9e _\u00b2"):
        for form in (text, *(f(D.words_of(text)) for f in VARIANTS.values())):
            words = D.split(pa.array([form]), D.TERM_BITS)
            assert np.array_equal(words.terms, D.split(pa.array([" ".join(D.words_of(form))]), D.TERM_BITS).terms)
            assert words.counts[0] == len(D.words_of(form))
            assert D.words_of(words.text(0, len(words.terms))) == D.words_of(form)


@pytest.mark.parametrize("variant", VARIANTS)
def test_exact_copies_in_other_characters(fitted, variant):
    docs, benchmark, space = fitted
    items = benchmark.limit(60).collect()
    search = D.Searcher(space, [p for r in items for p in D.pieces_of(r["item_id"], r["text"])])
    texts = pa.array([VARIANTS[variant](D.words_of(r["text"])) for r in items])
    assert all(r["item_id"] in found for r, found in zip(items, search.leaks(texts), strict=True))


def test_exact_copies_in_other_scripts(spark):
    docs = spark.createDataFrame(
        [(1, HINDI.replace(" ", "\u00a0")), (2, f"\u300c{CHINESE}\u300d"), (3, ACCENTS.upper()), (4, "nothing of them")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, HINDI), (2, CHINESE), (3, ACCENTS)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs, items, D.fit(docs)).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
