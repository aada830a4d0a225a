"""Longest path ranks against a plain walk, chains in few rounds, and cycles."""

import random

import pytest

from casegraph.operators import graph_metrics as gm


def plain(ids, edges):
    ids = set(ids)
    edges = [(a, b) for a, b in edges if a in ids and b in ids]
    waiting = {i: sum(b == i for _, b in edges) for i in ids}
    rank = dict.fromkeys(ids, 0)
    ready = [i for i in ids if not waiting[i]]
    while ready:
        a = ready.pop()
        for x, b in edges:
            if x == a:
                rank[b] = max(rank[b], rank[a] + 1)
                waiting[b] -= 1
                if not waiting[b]:
                    ready.append(b)
    return rank


def got(spark, ids, edges):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    table = spark.createDataFrame(edges, "source string, target string")
    rows = gm.longest_path_rank(nodes, table).collect()
    assert len(rows) == len(set(ids))
    return {r["id"]: r["rank"] for r in rows}


@pytest.mark.parametrize("seed, n, m", [(1, 12, 10), (2, 30, 28), (3, 25, 60), (4, 8, 20)])
def test_random_graphs(spark, seed, n, m):
    """Trees, joins, repeated edges, self loops, cycles and what hangs on them."""
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    edges = [(rng.choice(ids), rng.choice([*ids, "outside"])) for _ in range(m)]
    if seed < 4:
        edges = [(a, b) if a < b else (b, a) for a, b in edges] + [("n1", "n0"), ("n0", "n1")] * (seed == 3)
    assert got(spark, ids, edges) == plain(ids, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    stored = 0
    cut = gm.cut_lineage

    def counted(df):
        nonlocal stored
        stored += 1
        return cut(df)

    monkeypatch.setattr(gm, "cut_lineage", counted)
    ids = [f"{i:05d}" for i in range(10_000)]
    edges = list(zip(ids, ids[1:])) + [("a", ids[0]), ("b", ids[0]), ("x", "y"), ("y", "x"), ("y", "z")]
    ranks = got(spark, [*ids, "a", "b", "x", "y", "z"], edges)
    assert all(ranks[x] == k + 1 for k, x in enumerate(ids)) and ranks["a"] == ranks["x"] == ranks["z"] == 0
    assert stored <= 5 + 15 + 3
