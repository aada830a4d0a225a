"""What stays on disk while stages are stored and findings are fused."""

import os
import time

from pyspark.sql import functions as F

from casegraph.operators.components import connected_components
from casegraph.plans import fuse as fusion
from casegraph.session import discard, stored


def test_shuffles_and_tables_are_given_back(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = files.getAllFiles().size(), spark.conf.get(setting, "false")
    kept = stored(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.monotonic() + 10
    while files.getAllFiles().size() > before[0] and time.monotonic() < until:
        time.sleep(0.2)
    assert (files.getAllFiles().size(), spark.conf.get(setting, "false")) <= before
    assert kept.count() == 10 and os.path.isdir(kept.stored_path.removeprefix("file:"))
    discard(kept)
    assert not os.path.exists(kept.stored_path.removeprefix("file:"))


def test_rounds_are_dropped(spark):
    kept, dropped = [], []

    def keep(df):
        kept.append(stored(df))
        return kept[-1]

    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "src string, dst string")
    rows = connected_components(chain, keep=keep, drop=dropped.append).collect()
    assert len(rows) == 41 and {r["component"] for r in rows} == {"000"}
    assert dropped == kept[:-1] and len(kept) > 2


def test_rounds_work_on_sets_of_keys(spark, monkeypatch):
    """900 findings with three sets of keys, two of which share a key; ids need not be in order."""
    rows = [("c", f"{i * 7 % 900:04}", [["a", "1"]] if i % 3 == 0 else [["a", "1"], ["b", "2"]] if i % 3 == 1 else [["d", "3"], ["d", "3"]]) for i in range(900)]
    rows += [("c", "alone", [["e", "4"], ["f", "5"]]), ("other", "far", [["a", "1"]]), ("c", "none", [])]
    findings = spark.createDataFrame(rows, "collection_id string, id string, fusion_key array<array<string>>")
    edges = []

    def counted(df, **options):
        edges.append(df.count())
        return connected_components(df, **options)

    monkeypatch.setattr(fusion, "connected_components", counted)
    found = {r["id"]: r["cluster"] for r in fusion.cluster_members(findings).collect()}
    want = {}
    for i in range(900):
        want.setdefault("d" if i % 3 == 2 else "a", []).append(f"{i * 7 % 900:04}")
    assert found == {m: min(ids) for ids in want.values() for m in ids}
    assert edges == [4]
    monkeypatch.setattr(fusion, "SETS_SENT", 0)
    assert {r["id"]: r["cluster"] for r in fusion.cluster_members(findings).collect()} == found
