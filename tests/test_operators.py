"""Operators against brute force on small random inputs."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from casegraph.operators.components import connected_components
from casegraph.operators.fuzzy import common_length, fuzzy_pairs
from casegraph.operators.linking import expand_links, time_window_links
from casegraph.operators.nearest import nearest_join
from casegraph.operators.ordered import with_next, with_running

T0 = datetime(2024, 1, 1)


def union_find(pairs):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {a: find(a) for a in parent}


def same_parts(a: dict, b: dict) -> bool:
    """Equal partitions, whatever the labels."""
    def parts(m):
        out = {}
        for k, v in m.items():
            out.setdefault(v, set()).add(k)
        return sorted(map(sorted, out.values()))

    return parts(a) == parts(b)


def test_components_random_and_chain(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    pairs += [("hub", f"leaf{i}") for i in range(60)]
    got = {
        r["node"]: r["component"]
        for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()
    }
    assert same_parts(got, union_find(pairs))
    assert all(component == min(k for k in got if got[k] == component) for component in got.values())


def test_components_single_loop(spark):
    df = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert [tuple(r) for r in connected_components(df).collect()] == [("a", "a")]


def test_with_next_crosses_buckets(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", T0 + timedelta(seconds=rng.randrange(50000)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i bigint")
    got = {r["i"]: r["next"]["i"] if r["next"] else None for r in with_next(df, ["k"], "t", "i", ["i"], bucket_seconds=900).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((t, i) for kk, t, i in rows if kk == k)
        for at, (_, i) in enumerate(mine):
            want[i] = mine[at + 1][1] if at + 1 < len(mine) else None
    assert got == want


def test_with_running_crosses_buckets(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3)}", T0 + timedelta(seconds=rng.randrange(50000)), i, rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i bigint, v int")
    out = with_running(df, ["k"], "t", ["i"], {"s": F.col("v")}, {"last": F.when(F.col("v") == 1, F.col("t"))}, 700)
    got = {r["i"]: (r["s"], r["last"]) for r in out.collect()}
    for k in {r[0] for r in rows}:
        total, last = 0, None
        for t, i, v in sorted((t, i, v) for kk, t, i, v in rows if kk == k):
            total += v
            last = t if v else last
            assert got[i] == (total, last)


def test_nearest_join_against_brute_force(spark):
    rng = random.Random(4)

    def make(n):
        return [
            (f"k{rng.randrange(3)}", T0 + timedelta(milliseconds=500 * rng.randrange(400)), i, f"v{i}")
            for i in range(n)
        ]

    left, right = make(80), make(90)
    schema = "k string, t timestamp, o bigint, v string"
    got = {
        r["o"]: r["nearest"]["value"] if r["nearest"] else None
        for r in nearest_join(
            spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "t", "v", "o", 10
        ).collect()
    }
    for k, t, o, _ in left:
        near = [(abs(t - t2), o2, v2) for k2, t2, o2, v2 in right if k2 == k and abs(t - t2) <= timedelta(seconds=10)]
        assert got[o] == (min(near)[2] if near else None)


def link_inputs(seed, with_null):
    rng = random.Random(seed)

    def make(n, prefix):
        rows = []
        for _ in range(n):
            t = T0 + timedelta(minutes=rng.randrange(3000))
            if with_null and rng.random() < 0.1:
                t = None
            rows.append((f"k{rng.randrange(4)}", f"{prefix}{rng.randrange(60):02d}", t))
        return rows

    # Ids overlap on purpose: a finding may provide and require the same contract.
    times = {}
    p, q = make(60, "f"), make(70, "f")
    p = [(k, i, times.setdefault(i, t)) for k, i, t in p]
    q = [(k, i, times.setdefault(i, t)) for k, i, t in q]
    return sorted(set(p), key=str), sorted(set(q), key=str)


def brute_edges(p, q, window, untimed):
    out = set()
    for k, a, ta in p:
        for k2, b, tb in q:
            if k != k2 or a == b:
                continue
            if ta is None or tb is None:
                ok = untimed == "any" or (ta is None and tb is None)
            else:
                ok = abs(ta - tb) <= window
            if ok:
                out.add((k, a, b))
    return out


def test_links_ranges_skeleton_and_expansion(spark):
    for seed, with_null, untimed in ((5, False, "any"), (6, True, "any"), (7, True, "both")):
        p, q = link_inputs(seed, with_null)
        window = timedelta(hours=2)
        providers = spark.createDataFrame(p, "k string, id string, t timestamp")
        consumers = spark.createDataFrame(q, "k string, id string, t timestamp").withColumn(
            "window_s", F.lit(int(window.total_seconds()))
        )
        want = brute_edges(p, q, window, untimed)
        links = time_window_links(providers, consumers, ["k"], untimed, bucket_seconds=1800)
        counts = {(r["k"], r["target"]): r["n_sources"] for r in links.ranges.collect()}
        expected = {}
        for k, _, b in want:
            expected[(k, b)] = expected.get((k, b), 0) + 1
        assert counts == expected
        skeleton = {(r["k"], r["source"], r["target"]) for r in links.skeleton.collect()}
        assert skeleton <= want
        assert same_parts(union_find([(a, b) for _, a, b in skeleton]), union_find([(a, b) for _, a, b in want]))
        full = {(r["k"], r["source"], r["target"]) for r in expand_links(providers, consumers, ["k"], untimed).collect()}
        assert full == want


def test_fuzzy_pairs_lose_nothing(spark):
    rng = random.Random(8)
    base = ["net user backdoor p@ss /add", "whoami /all", "powershell -enc aaaabbbbcccc", "x", "ab", "reg add hklm\\run"]
    texts = []
    for _ in range(60):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            if rng.random() < 0.5 and text:
                text.pop(min(at, len(text) - 1))
            else:
                text.insert(at, rng.choice("abcxyz /"))
        texts.append("".join(text))
    left, right = texts[:30], texts[30:]
    got = {
        (r["left_text"], r["right_text"])
        for r in fuzzy_pairs(
            spark.createDataFrame([("g", t) for t in left], "g string, text string"),
            spark.createDataFrame([("g", t) for t in right], "g string, text string"),
            ["g"],
        ).collect()
    }
    want = {
        (a, b)
        for a in left
        for b in right
        if a.strip() and b.strip()
        and SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio() >= 0.9
    }
    assert got == want


def test_common_length_bounds_the_matcher():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd🙂") for _ in range(rng.randrange(30))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        assert common_length(a, b) == best[-1][-1]
        assert 2 * common_length(a, b) >= round(SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)))


def test_fuzzy_pairs_in_many_blocks(spark):
    """Long texts with edits around the threshold, several keys, blocks of a few texts."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefg hij") for _ in range(n)) for n in (60, 110, 240, 250)]
    rows = []
    for _ in range(120):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(int(0.3 * len(text)))):
            at = rng.randrange(len(text))
            kind = rng.random()
            text[at : at + 1] = [] if kind < 0.4 else [rng.choice("xyz")] if kind < 0.7 else [text[at], "é"]
        rows.append((rng.choice("kl"), "".join(text)))
    left, right = rows[:60], rows[60:]
    frames = [spark.createDataFrame(side, "g string, text string") for side in (left, right)]
    want = {
        (g, a, b) for g, a in left for h, b in right
        if g == h and SequenceMatcher(None, a.strip(), b.strip()).ratio() >= 0.9
    }
    assert want
    for block in (7, 2048):
        got = {(r["g"], r["left_text"], r["right_text"]) for r in fuzzy_pairs(*frames, ["g"], block).collect()}
        assert got == want

