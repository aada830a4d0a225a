"""The lookup table against plain turns, and placement of odd keys."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casegraph.llm import sharding as S


def plain_hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_table(shards, slots):
    offset = [plain_hash(f"shard-{i}/offset") % slots for i in range(shards)]
    step = [plain_hash(f"shard-{i}/step") % (slots - 1) + 1 for i in range(shards)]
    owner, turn, at = [-1] * slots, 0, [0] * shards
    while -1 in owner:
        i = turn % shards
        while owner[(offset[i] + at[i] * step[i]) % slots] != -1:
            at[i] += 1
        owner[(offset[i] + at[i] * step[i]) % slots] = i
        turn += 1
    return owner


@pytest.mark.parametrize(("shards", "slots"), [(1, 2), (1, 13), (3, 13), (7, 101), (13, 13)])
def test_table(spark, shards, slots):
    rows = sorted((r["slot"], r["shard"]) for r in S.lookup_table(spark, shards, slots).collect())
    assert [s for _, s in rows] == plain_table(shards, slots)
    sizes = Counter(s for _, s in rows).values()
    assert max(sizes) - min(sizes) <= 1


def test_bad_sizes(spark):
    for shards, slots in ((0, 13), (14, 13), (3, 12)):
        with pytest.raises(ValueError):
            S.lookup_table(spark, shards, slots)


def test_few_slots_move_when_a_shard_joins():
    before, after = plain_table(10, 1009), plain_table(11, 1009)
    moved = sum(a != b for a, b in zip(before, after, strict=True))
    assert moved / 1009 < 0.3


def test_odd_keys(spark, odd, none):
    owners = S.lookup_table(spark, 3, 13)
    rows = S.placed(odd, F.col("doc_id"), owners, 13)
    assert rows.columns[-2:] == ["slot_", "shard_"] or set(rows.columns) == {*odd.columns, "slot_", "shard_"}
    found = rows.collect()
    assert len(found) == odd.count()
    table = plain_table(3, 13)
    for r in found:
        slot = plain_hash("null" if r["doc_id"] is None else str(r["doc_id"])) % 13
        assert (r["slot_"], r["shard_"]) == (slot, table[slot])
    assert S.placed(none, F.col("doc_id"), owners, 13).count() == 0


def test_written_shards(spark, tmp_path, documents):
    owners = S.lookup_table(spark, 3, 13)
    # The path is shared here because the session is local.
    import casegraph.llm.sharding as module

    placed = module.placed(documents, F.col("doc_id"), owners, 13)
    S.write_shards(documents, F.col("doc_id"), S.lookup_table(spark), str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() == placed.count()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = S.op8_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
