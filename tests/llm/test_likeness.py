"""Near copies of the pipeline against the Jaccard index of all pairs."""

import random

import corpus_pipeline
from casegraph.llm import likeness, simhash


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(docs):
    """Pairs of ids whose texts are alike from 0.8 on."""
    sets = [(i, shingled(t)) for i, t in docs]
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                out.add((i, j))
    return out


def roots(ids, pairs):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return set(low.values())


def test_simhash_leaves_pairs_that_the_stage_finds(spark, sf_dir, documents):
    """3 of 64 bits alone leave alike texts here; the stage leaves none."""
    stages = dict(corpus_pipeline.STAGES)
    before = [(r["doc_id"], r["text"]) for r in simhash.one_per_group(documents, words=5).collect()]
    assert alike(before)
    after = stages["simhash_dedup"](spark, documents, sf_dir)
    assert after.columns == documents.columns
    assert {r["doc_id"] for r in after.collect()} == roots([i for i, _ in before], alike(before))


def test_links_grow_with_the_rows(spark):
    """Twice as many near copies give twice as many links at most: one for a row and leader, however small the block."""

    def count(n):
        rng = random.Random(6)
        words, rows = [f"h{rng.randrange(500)}" for _ in range(120)], []
        for k in range(n):
            changed = list(words)
            changed[rng.randrange(120)] = f"y{k}"
            rows.append((k, " ".join(changed)))
        pairs = [(r["src"], r["dst"]) for r in likeness.links(spark.createDataFrame(rows, "row long, text string"), 16).collect()]
        assert len(roots(range(n), pairs)) == 1
        return len(pairs)

    few, many = count(300), count(600)
    assert many <= 2.2 * few and few <= 8 * 300


def test_changed_copies(spark):
    """Copies with a few words changed, above and below the bound, in cells of one and of many blocks."""
    rng = random.Random(4)
    rows, hot = [], [f"h{rng.randrange(500)}" for _ in range(120)]
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for copy in range(3):
            changed = list(words)
            for at in rng.sample(range(150), copy * rng.randrange(1, 4)):
                changed[at] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(changed)))
    for k in range(80):
        changed = list(hot)
        changed[rng.randrange(120)] = f"y{k}"
        rows.append((len(rows), " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  words")]
    want = roots([i for i, _ in rows], alike(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in likeness.one_per_likeness(df).collect()} == want
    narrow = df.selectExpr("doc_id AS row", "text")
    for block in (7, 512):
        pairs = [(r["src"], r["dst"]) for r in likeness.links(narrow, block).collect()]
        assert roots([i for i, _ in rows], pairs) == want


def test_odd_rows(odd, none):
    assert likeness.one_per_likeness(none).count() == 0
    kept = likeness.one_per_likeness(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 3 and 5 not in ids and ids.count(None) == 2 and {1, 2, 3, 6, 7, 8, 9} <= set(ids)


def test_rows_are_told_apart(spark):
    """Nulls in other places, and columns of maps, arrays and structs."""
    rows = [
        (None, "one two three four five six seven", None, {"a": 1}, [1], (1,)),
        (None, None, "one two three four five six seven", {"a": 1}, [1], (1,)),
        (None, None, None, None, None, None),
        (1, "one two three four five six seven", None, {"a": 2}, None, None),
        (1, "one two three four five six seven", None, {"a": 2}, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, m map<string,int>, n array<int>, s struct<a:int>")
    got = simhash.one_per_group(df).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:3]) for r in got) == [("1", "one"), ("None", "Non")]
    kept = likeness.one_per_likeness(df)
    assert kept.columns == df.columns and kept.count() == 4
