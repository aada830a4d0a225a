"""A failure must not look like a result without findings."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casegraph.plans import rules_set
from casegraph.plans.detect import RuleSet, detect
from casegraph.plans.guarded import surviving
from casegraph.plans.rules_row import RowRule
from casegraph.session import cut_lineage
from casegraph.workloads import adapters as ad
from casegraph.workloads.queries import QUERIES, found


def test_a_job_that_fails_while_rules_are_built(spark, sf_dir, monkeypatch):
    """Group rules store their hits while they are built; that job fails."""
    whole = rules_set.stored

    def fails(df):
        return whole(df.withColumn("id", F.raise_error(F.lit("no space left")).cast("string")))

    monkeypatch.setattr(rules_set, "stored", fails)
    with pytest.raises(PySparkException, match="no space left"):
        QUERIES["mass_deletion"](spark, sf_dir)


def test_a_rule_that_cannot_be_built(spark, sf_dir, monkeypatch):
    def fails(view, rules):
        raise RuntimeError("broken rule")

    monkeypatch.setattr(rules_set, "group_hits", fails)
    with pytest.raises(RuntimeError, match="WIN_MASS_FILE_DELETE_001"):
        QUERIES["mass_deletion"](spark, sf_dir)


def test_queries_need_every_rule(spark, sf_dir, monkeypatch):
    """One of several rules is missing: ``detect`` names it, queries raise."""

    def fails(view, wanted=None):
        raise RuntimeError("broken rule")

    monkeypatch.setattr(rules_set, "login_findings", fails)
    events = cut_lineage(ad.web_events(spark, sf_dir))
    some = detect(events, RuleSet.of("WEB_BRUTE_FORCE_001", "WEB_LOGIN_SUCCESS_AFTER_BF_001"))
    assert some.left_out == ("login_after_failures",) and some.findings.count() > 0
    with pytest.raises(RuntimeError, match="rules left out: login_after_failures"):
        found(events, "WEB_BRUTE_FORCE_001", "WEB_LOGIN_SUCCESS_AFTER_BF_001")
    with pytest.raises(RuntimeError, match="WIN_USER_CREATED_001"):
        detect(events, RuleSet([RowRule("WIN_USER_CREATED_001", F.col("none"), F.lit("x"))], {}))


def test_a_failure_that_passes_is_nobodys_fault():
    """Whole jobs fail, single rules do not: none of them is left out."""

    def attempt(some):
        if len(some) > 1:
            raise ArithmeticError("too much at once")
        return some

    results, faults = surviving(range(5), attempt, lambda: None)
    assert [i for r in results for i in r] == [0, 1, 2, 3, 4] and not faults
