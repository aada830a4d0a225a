"""Hard negatives against all pairs in exact integers, and the bounds of the spanning tree."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import hard_negatives
from casegraph.llm.hard_negatives import Forest, quantised, spanning_tree

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=100):
    """All scores of all anchors, from rows (id, vector, label)."""
    kept = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, own, av in kept:
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, label, v in kept if i != a)
        for p, pid, _ in [s for s in scores if s[2] == own][:5]:
            near = [s for s in scores if s[2] != own and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(near)]
    return sorted(out)


def got(df, **options):
    out = hard_negatives.hard_negatives(quantised(df), F.col("id") % 100 == 0, **options)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    found = sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.op12_hard_negatives(spark, path).collect())
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = duckdb.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hard_negatives.ORACLE})").fetchall()
    assert found == sorted(want) and found


def clustered(n, seed=2, width=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


def test_many_blocks_and_trees(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "TREE", 3)
    rows = clustered(2500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert got(df) == plain(rows)


def test_bounds_hold_and_prune():
    rows = clustered(3000)
    data = np.floor(256 * np.array([v for _, v, _ in rows]))
    forest = Forest(np.arange(40), np.zeros(40, np.int64), data[:40])
    norms = np.sqrt((data**2).sum(axis=1))
    scored = 0

    def wanted(anchor, low, high):
        true = data @ forest.vectors[anchor]
        assert (low <= true).all() and (true <= high).all()
        return high >= np.partition(true, -5)[-5]

    for anchor, near, scores in forest.visit(data, norms, wanted):
        assert (scores == data[near] @ forest.vectors[anchor]).all()
        scored += len(near)
    assert scored < 0.8 * 40 * len(data)


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(1).normal(size=(60, 4))
    order, parent, edge = spanning_tree(points)
    assert sorted(order) == list(range(60)) and all(order.index(int(parent[i])) < order.index(i) for i in order[1:])
    pairs = sorted((float(np.linalg.norm(points[i] - points[j])), i, j) for i in range(60) for j in range(i))
    low, total = list(range(60)), 0.0
    for d, i, j in pairs:
        if low[i] != low[j]:
            total += d
            low = [low[j] if x == low[i] else x for x in low]
    assert abs(edge.sum() - total) < 1e-9


def test_odd_rows(spark):
    """Nulls, not finite, short and empty vectors, ties, repeated rows, large numbers and clashing columns."""
    v = [0.5, 0.25]
    rows = [
        (0, v, 1), (100, [], 1), (200, v, 2), (1, v, 1), (2, v, 1), (3, v, 2), (4, v, 2), (5, [0.5], 2), (6, None, 2), (7, [None, 1.0], 2),
        (8, [math.nan, 1.0], 2), (9, [math.inf, 1.0], 2), (10, v, None), (None, v, 2), (11, [-0.5, -0.25], 1), (12, v, 2), (13, [1e3, -2e3], 2),
        (300, [1e5, 1e5], 1), (14, [1e5, 1e5 - 1], 1), (15, [1e5, 1e5 - 3], 2),
    ]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("id", "v", "score", "slot", "rank")})
    assert got(df) == plain([(i, None if x is None else [*x, *[0.0] * (2 - len(x))], y) for i, x, y in rows])
    twice = got(df.unionByName(df.where("vec_id = 3")))
    assert [r for r in twice if r[0] == 0 and r[1] == 1 and r[3] == 3] == [(0, 1, 1, 3, 20480, 20480), (0, 1, 2, 3, 20480, 20480)]
    assert got(spark.createDataFrame([], schema)) == []
    huge = spark.createDataFrame([(0, [1e20], 1), (1, [1e20], 1)], schema)
    with pytest.raises(Exception, match="too large for exact scores"):
        got(huge)
