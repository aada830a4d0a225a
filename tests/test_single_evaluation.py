"""Expensive expressions stand once in the plans of the queries that use them."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from casegraph.functions import exprs as x


def optimised(spark, sf_dir: str, name: str) -> str:
    """The whole plan text: long lists are cut short by default."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_task_xml_is_parsed_once(spark, sf_dir):
    """One parse for created and one for updated tasks, whatever members are made of it."""
    for name in ("normalized_process_audit", "created_task_rule"):
        assert 0 < optimised(spark, sf_dir, name).count("xpath") <= 2, name


def test_wmi_message_is_read_once(spark, sf_dir):
    assert optimised(spark, sf_dir, "normalized_wmi").count("map_concat(") == 1
    # A subscription's rule reads the record's text only.
    assert optimised(spark, sf_dir, "wmi_row_rules").count("map_concat(") == 0


def test_wmi_records_are_dealt_to_all_tasks(spark, sf_dir):
    """A small table is one row group; its messages are taken apart by more tasks than the one that reads it."""
    for name in ("normalized_wmi", "normalized_wmi_other", "wmi_row_rules"):
        rows = queries()[name](spark, sf_dir).withColumn("task", F.spark_partition_id())
        assert rows.select("task").distinct().count() > 1, name


def test_rejected_rows_are_parsed_once(spark, sf_dir):
    """One parse of an element for each of the eleven channels, also where its faults decide whether it stays."""
    assert optimised(spark, sf_dir, "rejected_by_reason").count("from_json(") == 11


def test_texts_of_a_task(spark):
    xml = [
        "<T xmlns='u'><Exec><Command> a </Command><Arguments>-x</Arguments></Exec><Exec><Command>b</Command></Exec></T>",
        "<T><ComHandler><ClassId>{1}</ClassId></ComHandler></T>",
        "no xml",
        None,
    ]
    rows = spark.createDataFrame([(at, t) for at, t in enumerate(xml)], "at int, t string")
    texts = x.xml_texts(F.col("t"), ("Exec", "Command"), ("Exec", "Arguments"), ("ComHandler", "ClassId"))
    assert [r.v for r in rows.select("at", texts.alias("v")).orderBy("at").collect()] == [
        [" a ", "-x", ""],
        ["", "", "{1}"],
        None,
        None,
    ]


def test_clean_up_of_odd_texts(spark):
    """The forms that name their argument once give what the longer ones gave."""
    cases = [
        (x.non_empty, ["", None, " "], [None, None, " "]),
        (x.account_user, ["D\\u", "\\u", "u", "D\\a\\b", "D\\", None, ""], ["u", "u", "u", "a\\b", None, None, None]),
        (x.account_domain, ["D\\u", "\\u", "u", " D \\a\\b", None], ["D", None, None, "D", None]),
        (
            x.hex_to_int,
            ["0x0", "0x0000000000000000ff", "FF", "0xZZ", "0x", "", None, "0xFFFFFFFFFFFFFFFF", "0x10000000000000000"],
            [0, 255, 255, None, None, None, None, None, None],
        ),
        (x.logon_id, ["0x000", "'0X3E7'", "00ab", "x", "", None], ["0x0", "0x3e7", "0xab", None, None, None]),
        (
            x.command_line,
            ['CMD.exe /s /c "A b"', 'cmd /c "x" y"', 'cmd /c ""', "cmd /c x", 'cmd /c "a\nb"', " ", None],
            ["a b", 'x" y', 'cmd /c ""', "cmd /c x", 'cmd /c "a\nb"', None, None],
        ),
    ]
    for function, given, wanted in cases:
        rows = spark.createDataFrame(list(enumerate(given)), "at int, t string")
        got = [r.v for r in rows.select("at", function(F.col("t")).alias("v")).orderBy("at").collect()]
        assert got == wanted, function.__name__


def test_unread_payload_of_rules_is_not_computed(spark, sf_dir):
    """A listing of rule, severity and confidence makes no descriptions, and rows are spread without hashing records."""
    plan = optimised(spark, sf_dir, "file_row_rules")
    assert "format_string(" not in plan and "to_json" not in plan


def test_clusters_are_kept_as_tables(spark, sf_dir):
    """Rounds of the fusion leave no uncompressed checkpoints."""
    from pathlib import Path
    from urllib.parse import urlparse

    from casegraph.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("rdd-*"))
    assert queries()["fused_components"](spark, sf_dir).count() > 0
    assert set(folder.glob("rdd-*")) == before


def test_groups_are_counted_without_sorting_their_hits(spark, sf_dir):
    """All hits are reduced to numbers, updated in place; texts are read of fired groups' hits only."""
    from casegraph.functions.events import rule_view
    from casegraph.plans.rules_set import group_hits, group_rules, group_summaries
    from casegraph.workloads import adapters as ad

    view = rule_view(ad.web_events(spark, sf_dir))
    plan = group_summaries(group_hits(view, group_rules()))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_unread_members_of_events_are_not_computed(spark, sf_dir):
    """A view's column takes one member of its struct, and equal members of neighbouring parsers are one branch."""
    from casegraph.functions.events import rule_view
    from casegraph.plans.normalize_windows import normalize_log
    from casegraph.workloads import adapters as ad

    events = normalize_log(ad.sysmon_file_raw(spark, sf_dir), "sysmon")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        view = rule_view(events).select("raw_user_name", "guid", "event_code")
        plan = view._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "regexp_replace" in plan and "regexp_extract" not in plan and "[Archived]" not in plan
    # Parsers 1, 3, 7 and from 11 on read one member, 8 and 10 another.
    assert plan.count("regexp_replace(") == 3


def test_view_is_the_same_from_built_and_from_kept_events(spark, sf_dir):
    from casegraph.functions.events import rule_view
    from casegraph.plans.normalize_windows import normalize_log
    from casegraph.workloads import adapters as ad

    for events in (
        normalize_log(ad.sysmon_file_raw(spark, sf_dir).union(ad.sysmon_process_raw(spark, sf_dir)), "sysmon"),
        normalize_log(ad.security_raw(spark, sf_dir), "security"),
        ad.web_events(spark, sf_dir, attack=True),
    ):
        # A step in between leaves the structs of the events to read from.
        built, kept = rule_view(events), rule_view(events.where(F.lit(True)))
        assert built.schema == kept.schema
        names = [n for n in built.columns if n != "winlog_extra"]
        texts = [F.to_json("winlog_extra").alias("extra"), *names]
        left, right = built.select(texts), kept.select(texts)
        assert left.count() == right.count() > 0 == left.exceptAll(right).count()


def test_group_without_a_collection_keeps_its_events(spark, sf_dir):
    from casegraph.plans.detect import RuleSet, detect
    from casegraph.workloads import adapters as ad

    events = ad.web_events(spark, sf_dir)
    counts = []
    for rows in (events, events.withColumn("collection_id", F.lit(None).cast("string"))):
        found = detect(rows, RuleSet.of("WEB_BRUTE_FORCE_001"))
        counts.append((found.findings.count(), found.triggers.count(), found.findings.agg(F.sum("event_count")).first()[0]))
    assert counts[0] == counts[1] and counts[0][0] > 0
