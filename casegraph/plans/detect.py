"""Detection: row rules in one pass, group rules in one aggregation, two sequence rules.

Results are two relations.  ``findings`` has one row per finding; ``triggers`` has one row per
(finding, event), so no row ever holds a list that grows with the data.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegraph.functions import exprs as x
from casegraph.functions.events import rule_view
from casegraph.plans import rules_set
from casegraph.plans.catalog import RULE_NUMBER, rule_catalog
from casegraph.plans.guarded import surviving
from casegraph.plans.rules_row import (
    CAP_LIST,
    KEY_LIST,
    RowRule,
    default_row_rules,
    session_capability,
)
from casegraph.schemas import FINDING_DDL, TRIGGER_DDL
from casegraph.session import stored

log = logging.getLogger(__name__)

SetRule = Callable[[DataFrame], "Findings"]


@dataclass(frozen=True)
class Findings:
    """Findings and the events that triggered them."""

    findings: DataFrame
    triggers: DataFrame
    #: Names of the rules that could not be built or run and so have no findings here.
    left_out: tuple[str, ...] = ()
    #: The rules among them that failed while they ran, each with its error.
    faults: tuple[tuple[str, str], ...] = ()

    def union(self, other: Findings) -> Findings:
        return Findings(
            self.findings.unionByName(other.findings),
            self.triggers.unionByName(other.triggers),
            self.left_out + other.left_out,
            self.faults + other.faults,
        )

    def whole(self) -> Findings:
        """These findings, for callers that need all rules they asked for: raises if any was left out."""
        if self.left_out:
            errors = dict(self.faults)
            names = dict.fromkeys(self.left_out)
            raise RuntimeError("rules left out: " + "; ".join(f"{n} ({errors[n]})" if n in errors else n for n in names))
        return self


@dataclass
class RuleSet:
    """The rules of a run; extend it with :meth:`register`, narrow it with :meth:`only`."""

    row_rules: list[RowRule] = field(default_factory=list)
    set_rules: dict[str, SetRule] = field(default_factory=dict)

    @classmethod
    def default(cls) -> RuleSet:
        return cls(default_row_rules(), rules_set.default_set_rules())

    @classmethod
    def of(cls, *rule_ids: str) -> RuleSet:
        """The named rules of the default set."""
        wanted = set(rule_ids)
        return cls(
            default_row_rules(wanted),
            rules_set.select_set_rules(rules_set.default_set_rules(), wanted),
        )

    def register(self, rule: RowRule | tuple[str, SetRule]) -> RuleSet:
        if isinstance(rule, RowRule):
            self.row_rules.append(rule)
        else:
            self.set_rules[rule[0]] = rule[1]
        return self

    def only(self, *rule_ids: str) -> RuleSet:
        """A rule set with the named rules (grouped rules are selected inside their job)."""
        wanted = set(rule_ids)
        return RuleSet(
            [r for r in self.row_rules if r.rule_id in wanted],
            rules_set.select_set_rules(self.set_rules, wanted),
        )


def usable_rules(view: DataFrame, rules: list[RowRule]) -> list[tuple[RowRule, Column]]:
    """Rules with their payload struct.

    All rules are checked in one analysis; only if that fails is each tried alone, and the
    faulty ones are reported and left out.
    """
    built = []
    for rule in rules:
        try:
            body = F.struct(*_payload(rule), F.lit(rule.rule_id).alias("rule_id"))
        except Exception as error:  # noqa: BLE001 - any error disqualifies the rule
            log.warning("rule %s left out: %s", rule.rule_id, error)
        else:
            built.append((rule, body))

    def resolves(some: list[tuple[RowRule, Column]]) -> str | None:
        try:
            view.select(
                *[rule.when.cast("boolean").alias(f"w{at}") for at, (rule, _) in enumerate(some)],
                *[body.alias(f"p{at}") for at, (_, body) in enumerate(some)],
            )
        except Exception as error:  # noqa: BLE001
            return str(error)
        return None

    if resolves(built) is None:
        return built
    good = []
    for pair in built:
        error = resolves([pair])
        if error is None:
            good.append(pair)
        else:
            log.warning("rule %s left out: %s", pair[0].rule_id, error)
    return good


# ------------------------------------------------------------------ logon ids
def logon_lookup(view: DataFrame) -> DataFrame:
    """Logon id of the process-create event of each process, first one in order."""
    creates = view.where(
        (F.col("code") == "1") & F.col("guid").isNotNull() & F.col("own_logon_id").isNotNull()
    )
    first = F.min(F.struct("ord", "own_logon_id"))
    return creates.groupBy("collection_id", "channel", "guid").agg(
        first["own_logon_id"].alias("created_logon_id")
    )


def with_logon(rows: DataFrame, view: DataFrame) -> DataFrame:
    """Add ``logon_id``: the event's own, else that of the event's process."""
    # Rows without a process, or with an id of their own, need no lookup.  As most rows of most
    # channels are such, they get keys that no process has, spread over all tasks.
    lacking = F.col("guid").isNotNull() & F.col("own_logon_id").isNull()
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64("ord"), F.lit(4096)).cast("string"))
    keyed = rows.withColumn("_guid", F.when(lacking, F.col("guid")).otherwise(none))
    lookup = logon_lookup(view).withColumnRenamed("guid", "_guid")
    return (
        keyed.join(lookup, ["collection_id", "channel", "_guid"], "left")
        .withColumn("logon_id", F.coalesce("own_logon_id", "created_logon_id"))
        .drop("created_logon_id", "_guid")
    )


# ------------------------------------------------------------------ row rules
def _guarded(entries: tuple, type_name: str) -> Column:
    """Array of the entries whose condition holds."""
    if not entries:
        return F.array().cast(type_name)
    return F.array_compact(
        F.array(*[e if cond is None else F.when(cond, e) for cond, e in entries])
    ).cast(type_name)


def _keys(keys: tuple[tuple[Column, ...], ...]) -> Column:
    """Fusion keys; a key with a null part is dropped, it would join unrelated findings."""
    guarded = tuple(
        (~x.any_of([p.isNull() for p in parts]), F.array(*[p.cast("string") for p in parts]))
        for parts in keys
    )
    return _guarded(guarded, KEY_LIST)


PAYLOAD = (
    "description",
    "extra",
    "entities",
    "requires",
    "provides",
    "fusion_key",
    "own_severity",
    "own_confidence",
    "own_technique_id",
    "own_technique_name",
)


def _payload(rule: RowRule) -> list[Column]:
    def text_map(entries: dict[str, Column]) -> Column:
        return x.string_map(**entries) if entries else F.create_map().cast("map<string,string>")

    technique = rule.technique or (x.null_string(), x.null_string())
    severity = x.null_string() if rule.severity is None else rule.severity
    confidence = F.lit(None) if rule.confidence is None else rule.confidence
    return [
        rule.description.alias("description"),
        text_map(rule.extra).alias("extra"),
        text_map(rule.entities).alias("entities"),
        _guarded(rule.requires, CAP_LIST).alias("requires"),
        _guarded(rule.provides, CAP_LIST).alias("provides"),
        _keys(rule.keys).alias("fusion_key"),
        severity.alias("own_severity"),
        confidence.cast("double").alias("own_confidence"),
        technique[0].alias("own_technique_id"),
        technique[1].alias("own_technique_name"),
    ]


def _chosen(rules: list[RowRule]) -> dict[str, Column]:
    """The payload of each hit's rule, a column for each member: what no caller reads is not computed."""
    chosen: dict[str, Column] = {}
    for at, rule in enumerate(rules):
        test = F.col("rule_at") == at
        members = dict(zip(PAYLOAD, _payload(rule), strict=True), rule_id=F.lit(rule.rule_id))
        for name, value in members.items():
            chosen[name] = chosen[name].when(test, value) if name in chosen else F.when(test, value)
    return {name: x.once(value) for name, value in chosen.items()}


def row_hits(view: DataFrame, rules: list[RowRule]) -> DataFrame:
    """Rows with at least one matching rule, one output row per match (column ``rule_at``)."""
    matched = F.array_compact(
        F.array(*[F.when(rule.when, F.lit(at)) for at, rule in enumerate(rules)])
    )
    return (
        view.withColumn("_rules", x.once(matched))
        .where(F.size("_rules") > 0)
        .withColumn("rule_at", F.explode("_rules"))
        .drop("_rules")
    )


def row_findings(view: DataFrame, rules: list[RowRule], stage: bool = False) -> Findings:
    """Findings of all row rules from one scan of the events.

    With ``stage`` the hits are stored once, for callers that read findings and triggers both.
    """
    usable = usable_rules(view, rules)
    left_out = tuple({r.rule_id for r in rules} - {r.rule_id for r, _ in usable})
    if not usable:
        return Findings(*_none(view.sparkSession), left_out)
    hits = with_logon(row_hits(view, [rule for rule, _ in usable]), view)
    rows = hits.withColumns(_chosen([rule for rule, _ in usable]))
    rows = rows.join(F.broadcast(rule_catalog(view.sparkSession)), "rule_id")

    logged_on = F.col("logon_id").isNotNull()
    needs_session = (
        logged_on
        & (F.col("rule_type") == "per_event")
        & (F.col("rule_id") != "WIN_REMOTE_LOGIN_001")
    )
    requires = F.when(
        needs_session,
        F.array_distinct(
            F.concat("requires", F.array(session_capability(F.col("logon_id"))).cast(CAP_LIST))
        ),
    ).otherwise(F.col("requires"))
    phase = F.when(F.col("rule_type") == "per_event", 0).otherwise(1)
    findings = rows.select(
        "collection_id",
        "channel",
        x.stable_id(F.col("collection_id"), F.col("channel"), F.col("rule_id"), F.col("id")).alias(
            "id"
        ),
        F.struct(
            F.col("channel").alias("channel"),
            phase.alias("phase"),
            F.when(phase == 0, F.col("ord")).otherwise(F.col("rule_no")).cast("bigint").alias("a"),
            F.when(phase == 0, F.col("rule_no")).otherwise(F.col("ord")).cast("bigint").alias("b"),
        ).alias("ord"),
        F.col("created").alias("timestamp"),
        "rule_id",
        "rule_name",
        "rule_type",
        requires.alias("requires"),
        "provides",
        "fusion_key",
        F.coalesce("own_severity", "severity").alias("severity"),
        F.coalesce("own_confidence", "confidence").alias("confidence"),
        F.coalesce("own_technique_id", "technique_id").alias("technique_id"),
        F.coalesce("own_technique_name", "technique_name").alias("technique_name"),
        "tactic",
        "kill_chain_phase",
        "tags",
        "source",
        "description",
        F.lit(1).cast("bigint").alias("event_count"),
        with_logon_entry(F.col("extra"), F.col("logon_id")).alias("extra"),
        "entities",
        "logon_id",
        "is_probe",
        rules_set.facts(
            F.coalesce(F.col("extra")["remote_ip"], x.non_empty(F.col("src_ip")))
        ).alias("facts"),
        F.col("id").alias("_event_id"),
        F.col("ord").alias("_event_ord"),
    )
    if stage:
        findings = stored(findings)
    triggers = findings.select(
        "collection_id",
        "channel",
        F.col("id").alias("finding_id"),
        F.col("_event_id").alias("event_id"),
        F.col("_event_ord").alias("ord"),
        x.null_string().alias("value"),
    )
    return Findings(conform(findings), triggers, left_out)


def with_logon_entry(extra: Column, logon: Column) -> Column:
    """The resolved logon id belongs to the extra entries too."""
    without = F.map_filter(extra, lambda k, _: k != "logon_id")
    return F.when(
        logon.isNotNull(), F.map_concat(without, F.map_from_arrays(F.array(F.lit("logon_id")), F.array(logon)))
    ).otherwise(without)


def conform(findings: DataFrame) -> DataFrame:
    """Exactly the finding schema."""
    return findings.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(FINDING_DDL).fields]
    )


def conform_triggers(triggers: DataFrame) -> DataFrame:
    return triggers.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TRIGGER_DDL).fields]
    )


# ------------------------------------------------------------------ entry point
def _probe(view: DataFrame) -> None:
    """Read all that rules read, without a rule."""
    view.write.format("noop").mode("overwrite").save()


def _row_jobs(view: DataFrame, rules: list[RowRule]) -> Findings | None:
    """Findings of the row rules, stored; rules that fail while they run are left out and named."""
    found, faults = surviving(rules, lambda some: row_findings(view, some, stage=True), lambda: _probe(view))
    failed = tuple((rule.rule_id, error) for rule, error in faults)
    return _joined(found, failed)


def _set_jobs(view: DataFrame, name: str, job: SetRule) -> Findings | None:
    """Findings of one set job, stored; a job of several rules is halved by them."""

    def attempt(some: list[str]) -> Findings:
        chosen = rules_set.select_set_rules({name: job}, set(some))[name] if some != [name] else job
        found = chosen(view)
        return Findings(stored(conform(found.findings)), stored(conform_triggers(found.triggers)))

    found, faults = surviving(rules_set.rules_of(name, job), attempt, lambda: _probe(view))
    return _joined(found, tuple(faults))


def _joined(found: list[Findings], faults: tuple[tuple[str, str], ...]) -> Findings | None:
    if not found:
        return None if not faults else Findings(None, None, tuple(n for n, _ in faults), faults)
    result = found[0]
    for part in found[1:]:
        result = result.union(part)
    return replace(result, left_out=result.left_out + tuple(n for n, _ in faults), faults=faults)


def _ends_run(error: Exception) -> bool:
    """Whether an error came from running a job, not from building a rule.

    Group rules store their hits while they are built, so their jobs can fail there: for want of disk, memory or input.
    """
    planned = isinstance(error, (AnalysisException, ParseException))
    return isinstance(error, (PySparkException, Py4JError, OSError, MemoryError)) and not planned


def detect(
    events: DataFrame, rules: RuleSet | None = None, channels: list[str] | None = None, stage: bool = False
) -> Findings:
    """Run the rules over normalised events, optionally over chosen channels only.

    A rule that cannot be built does not stop the others; the result names it in ``left_out``, and
    callers that need every rule use :meth:`Findings.whole`.  A job that fails while it runs is no such
    rule and raises, and so does a call of which no rule can be built.  With ``stage`` the jobs run here
    and their findings are stored, and a rule that fails while it runs is left out as well and named in
    ``faults``; such a result may hold no rule at all.
    """
    rules = rules or RuleSet.default()
    if channels:
        events = events.where(F.col("channel").isin(*channels))
    view = rule_view(events)
    parts: list[Findings] = []
    left_out: tuple[str, ...] = ()
    cause: Exception | None = None
    if rules.row_rules:
        parts.append(_row_jobs(view, rules.row_rules) if stage else row_findings(view, rules.row_rules))
    for name, rule in rules.set_rules.items():
        try:
            if stage:
                parts.append(_set_jobs(view, name, rule))
                continue
            found = rule(view)
            parts.append(Findings(conform(found.findings), conform_triggers(found.triggers)))
        except Exception as error:  # noqa: BLE001 - one faulty rule must not stop the others
            if _ends_run(error):
                raise
            if stage:
                _probe(view)
            log.warning("set rule %s left out: %s", name, error)
            left_out += tuple(rules_set.rules_of(name, rule))
            cause = error
    faults = tuple(f for p in parts for f in p.faults)
    left_out = tuple(n for p in parts for n in p.left_out) + left_out
    asked = [r.rule_id for r in rules.row_rules] + [n for name, job in rules.set_rules.items() for n in rules_set.rules_of(name, job)]
    if not asked:
        raise ValueError("no rule to run")
    if not stage and not set(asked) - set(left_out):
        # No rows of no rule would look like no findings.
        raise RuntimeError(f"no rule could be built: {', '.join(dict.fromkeys(left_out))}") from cause
    found = [p for p in parts if p.findings is not None]
    if not found:
        return Findings(*_none(view.sparkSession), left_out, faults)
    return replace(_joined(found, ()), left_out=left_out, faults=faults)


def _none(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], FINDING_DDL), spark.createDataFrame([], TRIGGER_DDL)


def rule_faults(spark, found: Findings) -> DataFrame:
    """``rule_id, error``: the rules without findings; the error is null where it came while planning."""
    errors = dict(found.faults)
    rows = [(n, errors.get(n)) for n in dict.fromkeys(found.left_out)]
    return spark.createDataFrame(rows, "rule_id string, error string")


__all__ = ["Findings", "RuleSet", "SetRule", "detect", "row_findings", "row_hits", "rule_faults", "RULE_NUMBER"]
