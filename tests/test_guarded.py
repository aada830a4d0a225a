"""Rules that fail while they run."""

import math

import pytest
from pyspark.sql import functions as F

from casegraph.plans.detect import RuleSet, detect
from casegraph.plans.guarded import surviving
from casegraph.plans.rules_row import RowRule
from casegraph.session import cut_lineage
from casegraph.sources import tables
from casegraph.workloads import adapters as ad


@pytest.mark.parametrize("n, faulty", [(1, {0}), (46, {17}), (46, {0, 45}), (8, set()), (5, {0, 1, 2, 3, 4}), (33, {31, 32})])
def test_halving(n, faulty):
    failed = 0

    def attempt(some):
        nonlocal failed
        if faulty & set(some):
            failed += 1
            raise ArithmeticError("by zero\nmore")
        return some

    results, faults = surviving(range(n), attempt, lambda: None)
    assert sorted(i for r in results for i in r) == [i for i in range(n) if i not in faulty]
    assert faults == [(i, "by zero") for i in sorted(faulty)]
    if len(faulty) == 1:
        assert failed <= 1 + math.ceil(math.log2(n)) and len(results) <= max(1, math.ceil(math.log2(n)))


def test_a_fault_without_rules_ends_the_run():
    def attempt(some):
        raise ArithmeticError("x")

    def probe():
        raise RuntimeError("no storage")

    with pytest.raises(RuntimeError, match="no storage"):
        surviving([1, 2], attempt, probe)


def test_a_rule_that_divides_by_zero(spark, sf_dir, tmp_path):
    """The others keep all their findings; the rule is named with its error, and stored."""
    events = cut_lineage(ad.web_events(spark, sf_dir, attack=True))
    want = detect(events, RuleSet.default())
    # One event in the middle makes the rule fail; it cannot be seen while the plan is built.
    at = events.agg(F.percentile_approx("ord", 0.5)).first()[0]
    faulty = RowRule("WIN_USER_CREATED_001", F.lit(1) / (F.col("ord") - at) > 5, F.lit("never"))
    rules = RuleSet.default()
    rules.row_rules[7:7] = [faulty]
    found = detect(events, rules, stage=True)
    assert found.left_out == ("WIN_USER_CREATED_001",) and "DIVIDE_BY_ZERO" in found.faults[0][1]

    def listed(df):
        return sorted(map(str, df.select("id", "rule_id", "severity", "extra", "ord").collect()))

    assert listed(found.findings) == listed(want.findings) and want.findings.count() > 0
    assert found.triggers.count() == want.triggers.count()
    tables.write_findings(found, str(tmp_path))
    stored = tables.read_rule_faults(spark, str(tmp_path)).collect()
    assert [r["rule_id"] for r in stored] == ["WIN_USER_CREATED_001"] and stored[0]["error"]


def test_a_set_rule_that_fails_while_it_runs(spark, sf_dir):
    events = cut_lineage(ad.web_events(spark, sf_dir))

    def broken(view):
        found = RuleSet.of("WEB_BRUTE_FORCE_001").set_rules["group_rules"](view)
        return type(found)(found.findings.withColumn("event_count", F.raise_error(F.lit("broken")).cast("bigint")), found.triggers)

    rules = RuleSet.of("WEB_BRUTE_FORCE_001", "WEB_RECON_SCAN_001").register(("broken", broken))
    found = detect(events, rules, stage=True)
    assert found.left_out == ("broken",) and "broken" in found.faults[0][1]
    assert found.findings.count() == detect(events, RuleSet.of("WEB_BRUTE_FORCE_001", "WEB_RECON_SCAN_001")).findings.count() > 0


def test_nothing_is_left(spark, sf_dir):
    events = ad.web_events(spark, sf_dir)
    rules = RuleSet([RowRule("WIN_USER_CREATED_001", F.lit(1) / (F.col("ord") - F.col("ord")) > 0, F.lit("x"))], {})
    found = detect(events, rules, stage=True)
    assert found.findings.count() == 0 and found.left_out == ("WIN_USER_CREATED_001",)
