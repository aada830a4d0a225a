"""Set rules: group-and-threshold rules, script-block pairs, and login after failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x
from casegraph.operators.ordered import with_next
from casegraph.plans.catalog import RULE_NUMBER, rule_catalog
from casegraph.plans.rules_row import CAP_LIST, KEY_LIST, capability, session_capability, text
from casegraph.session import cut_lineage, shuffles_given_back, stored

c = F.col

GROUP_KEYS = ["collection_id", "channel", "rule_id", "key"]


def facts(ip: Column) -> Column:
    """Facts of an event that correlation reads later."""
    return F.struct(
        c("event_time").alias("event_time"),
        ip.alias("ip"),
        c("guid").alias("guid"),
        c("pid").alias("pid"),
        c("parent_guid").alias("parent_guid"),
        c("parent_pid").alias("parent_pid"),
        c("process").alias("process"),
        c("raw_user_name").alias("user"),
    )


# ------------------------------------------------------------------ group rules
@dataclass(frozen=True)
class GroupRule:
    """Events that pass ``when`` are grouped by ``key``; the group fires if ``fires`` holds.

    ``fires`` and the result columns read the group's columns: ``key`` (array), ``n`` and
    ``span`` (seconds from first to last); the result columns also ``first``, the first hit.
    """

    rule_id: str
    when: Column
    key: tuple[Column, ...]
    value: Column
    fires: Column
    description: Column
    extra: dict[str, Column]
    entities: dict[str, Column]
    confidence: Column | None = None
    provides: Column | None = None
    requires: tuple[Column, Column] | None = None
    fusion: tuple[Column, ...] | None = None
    by_time: bool = False
    sample: tuple[str, int] | None = None
    event_count: Column | None = None


def group_rules() -> list[GroupRule]:
    key0, key1, n = c("key")[0], c("key")[1], c("n")
    user = F.when(c("user_name") == "", F.lit("unknown")).otherwise(c("user_name"))
    auth_word = x.any_of([key1.contains(word) for word in fv.AUTH_URL_WORDS])
    denied = c("status").isin(401, 403) | ((c("method") == "post") & (c("status") == 302))
    tool = F.lower(x.group(c("user_agent"), fv.SCANNER_AGENT))
    actor = F.coalesce(c("own_logon_id"), c("guid"))
    mac = F.lower(c("host_mac"))
    return [
        GroupRule(
            "WIN_BRUTE_FORCE_001",
            when=(c("event_code") == 4625) & (user != "-"),
            key=(user,),
            value=x.null_string(),
            fires=n >= fv.LOGON_FAILURE_THRESHOLD,
            description=text("%s failed login attempts for '%s'", n, key0),
            extra={"target_user": key0},
            entities={},
        ),
        GroupRule(
            # Entries are counted, not distinct addresses.
            "NET_ARP_POISONING_001",
            when=(mac != "") & (c("host_ip") != "") & (mac != fv.BROADCAST_MAC),
            key=(mac,),
            value=c("host_ip"),
            fires=n >= fv.ARP_ENTRY_THRESHOLD,
            description=text("MAC '%s' associated with %s IPs", key0, n),
            extra={"mac": key0, "ip_count": n},
            entities={},
        ),
        GroupRule(
            "WIN_MASS_FILE_DELETE_001",
            when=(c("event_code") == 26) & c("file_path").isNotNull() & actor.isNotNull(),
            key=(actor,),
            value=c("file_path"),
            fires=(n >= fv.MASS_DELETE_THRESHOLD)
            & (c("span") <= fv.MASS_DELETE_WINDOW_SECONDS),
            description=text(
                "%s file deletions in %ss by actor %s", n, F.floor(c("span")), key0
            ),
            extra={
                "file_count": n,
                "window_seconds": F.floor(c("span")),
                "logon_id": c("first")["own_logon_id"],
                "actor_key": key0,
            },
            entities={},
            requires=(
                c("first")["own_logon_id"].isNotNull(),
                session_capability(c("first")["own_logon_id"]),
            ),
            fusion=(F.lit("mass_deletion"), key0),
            by_time=True,
            sample=("files_deleted", fv.MASS_DELETE_SAMPLE),
            event_count=F.lit(1),
        ),
        GroupRule(
            "WEB_BRUTE_FORCE_001",
            when=x.non_empty(c("src_ip")).isNotNull() & denied,
            key=(c("src_ip"), c("url")),
            value=c("url"),
            fires=n >= fv.WEB_FAILURE_THRESHOLD,
            description=text("%s repeated requests to '%s' from %s", n, key1, key0),
            extra={"source_ip": key0, "target_url": key1},
            entities={"source_ip": key0},
            confidence=F.when(auth_word, F.lit(0.95)).otherwise(F.lit(0.80)),
            provides=capability("credential_candidate", source_ip=key0),
        ),
        GroupRule(
            "WEB_RECON_SCAN_001",
            when=(c("status") == 404) & x.non_empty(c("src_ip")).isNotNull(),
            key=(c("src_ip"),),
            value=c("url"),
            fires=n >= fv.RECON_THRESHOLD,
            description=text("%s 404 requests from %s — possible directory scan", n, key0),
            extra={"source_ip": key0},
            entities={"source_ip": key0},
            sample=("sample_urls", fv.RECON_SAMPLE),
        ),
        GroupRule(
            "WEB_SCANNER_UA_001",
            when=tool.isNotNull(),
            key=(tool, F.coalesce(x.non_empty(c("src_ip")), F.lit("unknown"))),
            value=c("url"),
            fires=n >= 1,
            description=text(
                "Scanning tool '%s' detected — %s requests from %s", key0, n, key1
            ),
            extra={"tool": key0, "source_ip": key1},
            entities={},
        ),
    ]


def group_hits(view: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """(rule, key, event) rows of all group rules from one scan."""
    none = F.array().cast("array<struct<rule_id: string, key: array<string>, value: string, sort_time: timestamp>>")
    entries = [
        F.when(
            rule.when,
            F.array(
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.array(*[k.cast("string") for k in rule.key]).alias("key"),
                    rule.value.alias("value"),
                    # Rules that go by time sort on it first, the others keep the event order.
                    F.when(F.lit(rule.by_time), c("event_time")).alias("sort_time"),
                )
            ),
        ).otherwise(none)
        for rule in rules
    ]
    matched = view.withColumn("_hits", x.once(F.flatten(F.array(*entries)))).where(
        F.size("_hits") > 0
    )
    exploded = matched.select(
        *[name for name in matched.columns if name != "_hits"], F.explode("_hits").alias("_h")
    )
    return exploded.select(
        "collection_id",
        "channel",
        "_h.*",
        "ord",
        "id",
        "event_time",
        "created",
        "src_ip",
        "guid",
        "pid",
        "parent_guid",
        "parent_pid",
        "process",
        "raw_user_name",
        "own_logon_id",
        "is_probe",
    )


def group_summaries(hits: DataFrame) -> DataFrame:
    """One row per (rule, key): all group rules share this one partial aggregation.

    It has numbers only, which are updated in place without sorting the hits; the rest of a group is
    made of the hits of fired groups, see :func:`_firsts`.
    """
    spread = F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))
    return hits.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        (spread / 1_000_000).alias("span"),
        F.max("is_probe").alias("is_probe"),
    )


def _firsts(fired_hits: DataFrame) -> DataFrame:
    """First event, and first address, of each fired group."""
    order = F.struct("sort_time", "ord")

    def first(column: Column, where: Column | None = None) -> Column:
        item = F.struct(order.alias("o"), column.alias("v"))
        return F.min(item if where is None else F.when(where, item))["v"]

    first_row = F.struct(
        facts(x.null_string()).alias("facts"), c("created"), c("own_logon_id"), c("ord")
    )
    return fired_hits.groupBy(c("finding_id").alias("id")).agg(
        first(first_row).alias("first"),
        first(c("src_ip"), x.non_empty(c("src_ip")).isNotNull()).alias("first_ip"),
    )


def _case(rules: list[GroupRule], pick: Callable[[GroupRule], Column | None], default: Column) -> Column:
    result = None
    for rule in rules:
        value = pick(rule)
        if value is None:
            continue
        test = c("rule_id") == rule.rule_id
        result = F.when(test, value) if result is None else result.when(test, value)
    return default if result is None else result.otherwise(default)


def group_findings(view: DataFrame, wanted: set[str] | None = None):
    """Findings of the group rules."""
    from casegraph.plans.detect import Findings, with_logon_entry

    rules = [r for r in group_rules() if wanted is None or r.rule_id in wanted]
    # All groups read the hits, and few groups fire: the hits are stored once, narrow, and so are those of fired
    # groups, which triggers, samples, first events and the logon ids of other events come from.
    hits = stored(group_hits(view, rules))
    summaries = group_summaries(hits)
    fired = summaries.where(_case(rules, lambda r: r.fires, F.lit(False))).withColumn(
        "id",
        x.stable_id(
            c("collection_id"), c("channel"), c("rule_id"), F.array_join("key", "|", "∅")
        ),
    )
    fired = stored(fired)
    fired_hits = stored(_hits_of(fired, hits))
    triggers = _group_triggers(fired_hits)
    fired = fired.join(_firsts(fired_hits), "id").join(_group_logons(fired_hits, view), "id", "left")

    empty_map = F.create_map().cast("map<string,string>")
    fired = fired.join(_samples(triggers, rules), "id", "left").join(
        F.broadcast(
            rule_catalog(view.sparkSession).withColumnRenamed("confidence", "fixed_confidence")
        ),
        "rule_id",
    )
    extra = _case(rules, lambda r: x.string_map(**r.extra), empty_map)
    with_sample = F.when(
        c("sample").isNotNull(),
        F.map_concat(
            extra, F.map_from_arrays(F.array("sample_name"), F.array(F.to_json("sample")))
        ),
    ).otherwise(extra)
    none = F.array().cast(CAP_LIST)
    findings = fired.select(
        "collection_id",
        "channel",
        "id",
        F.struct(
            c("channel").alias("channel"),
            F.lit(1).alias("phase"),
            c("rule_no").cast("bigint").alias("a"),
            c("first")["ord"].alias("b"),
        ).alias("ord"),
        c("first")["created"].alias("timestamp"),
        "rule_id",
        "rule_name",
        "rule_type",
        _case(
            rules,
            lambda r: None
            if r.requires is None
            else F.when(r.requires[0], F.array(r.requires[1]).cast(CAP_LIST)).otherwise(none),
            none,
        ).alias("requires"),
        _case(
            rules,
            lambda r: None if r.provides is None else F.array(r.provides).cast(CAP_LIST),
            none,
        ).alias("provides"),
        _case(
            rules,
            lambda r: None if r.fusion is None else F.array(F.array(*r.fusion)),
            F.array().cast(KEY_LIST),
        ).alias("fusion_key"),
        "severity",
        _case(rules, lambda r: r.confidence, c("fixed_confidence")).alias("confidence"),
        "technique_id",
        "technique_name",
        "tactic",
        "kill_chain_phase",
        "tags",
        "source",
        _case(rules, lambda r: r.description, x.null_string()).alias("description"),
        _case(rules, lambda r: r.event_count, c("n")).alias("event_count"),
        with_logon_entry(with_sample, c("logon_id")).alias("extra"),
        _case(rules, lambda r: x.string_map(**r.entities) if r.entities else None, empty_map).alias(
            "entities"
        ),
        "logon_id",
        "is_probe",
        c("first")["facts"].withField("ip", c("first_ip")).alias("facts"),
    )
    return Findings(findings, triggers)


def _hits_of(fired: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of the groups that fired; the fired side is unique per key, so skew can be split."""
    keys = fired.select(*[c(k).alias(f"_{k}") for k in GROUP_KEYS], c("id").alias("finding_id"))
    same = [c(k).eqNullSafe(c(f"_{k}")) if k == "collection_id" else c(k) == c(f"_{k}") for k in GROUP_KEYS]
    return hits.join(keys, same).drop(*[f"_{k}" for k in GROUP_KEYS])


def _group_logons(fired_hits: DataFrame, view: DataFrame) -> DataFrame:
    """First logon id among the events of each fired group."""
    from casegraph.plans.detect import with_logon

    own = with_logon(fired_hits, view)
    item = F.struct(F.struct("sort_time", "ord").alias("o"), c("logon_id").alias("v"))
    return (
        own.where(c("logon_id").isNotNull())
        .groupBy(c("finding_id").alias("id"))
        .agg(F.min(item)["v"].alias("logon_id"))
    )


def _group_triggers(fired_hits: DataFrame) -> DataFrame:
    """Events of the groups that fired."""
    return fired_hits.select(
        "collection_id",
        "channel",
        "finding_id",
        c("id").alias("event_id"),
        "ord",
        "value",
        "sort_time",
        "rule_id",
    )


def _samples(triggers: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """First k values of the findings that show a sample; k is a feature of the rule."""
    sampled = [r for r in rules if r.sample]
    limit = _case(sampled, lambda r: F.lit(r.sample[1]), F.lit(0))
    name = _case(sampled, lambda r: F.lit(r.sample[0]), x.null_string())
    widest = max([r.sample[1] for r in sampled], default=0)
    rank = F.row_number().over(W.partitionBy("finding_id").orderBy("sort_time", "ord"))
    top = (
        triggers.where(c("rule_id").isin(*[r.rule_id for r in sampled]) if sampled else F.lit(False))
        .withColumn("_rank", rank)
        .where(c("_rank") <= widest)
        .where(c("_rank") <= limit)
    )
    return top.groupBy(c("finding_id").alias("id"), name.alias("sample_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]).alias(
            "sample"
        )
    )


# ------------------------------------------------------------------ script blocks
def script_block_findings(view: DataFrame, wanted: set[str] | None = None):
    """Started-never-completed blocks, and suspicious blocks that were really started.

    One aggregation per block id answers both the anti join and the inner join.
    """
    from casegraph.plans.detect import Findings, with_logon, with_logon_entry

    blocks = with_logon(view.where(c("block_id").isNotNull()), view)
    started = c("action") == "scriptblock-started"
    suspicious = (c("action") == "scriptblock-logged") & x.matches(c("script"), fv.SUSPICIOUS_SCRIPT)
    item = F.struct(
        "ord",
        "id",
        "created",
        "runspace_id",
        "hostname",
        "script",
        "logon_id",
        "is_probe",
        facts(x.non_empty(c("src_ip"))).alias("facts"),
    )
    per_block = blocks.groupBy("collection_id", "channel", "block_id").agg(
        F.max(F.when(started, item)).alias("start"),
        F.min(F.when(started, c("ord"))).alias("first_start"),
        F.max(F.when(suspicious, item)).alias("logged"),
        F.min(F.when(suspicious, c("ord"))).alias("first_logged"),
        F.coalesce(F.max(c("action") == "scriptblock-completed"), F.lit(False)).alias("completed"),
    )
    orphaned = c("start").isNotNull() & ~c("completed")
    confirmed = c("start").isNotNull() & c("logged").isNotNull()
    script = c("logged")["script"]
    patterns = F.regexp_extract_all(script, F.lit(x.java(fv.SUSPICIOUS_SCRIPT)), F.lit(0))
    shown = F.concat(
        F.lit("["),
        F.array_join(F.transform(F.slice(patterns, 1, 3), lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "),
        F.lit("]"),
    )
    short_id = F.substring("block_id", 1, 8)
    empty = F.create_map().cast("map<string,string>")

    def finding(rule_id: str, lead: Column, first_ord: Column, description: Column, extra: dict, count: int) -> Column:
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            lead["created"].alias("timestamp"),
            first_ord.alias("first_ord"),
            description.alias("description"),
            x.string_map(**extra).alias("extra"),
            F.lit(count).cast("bigint").alias("event_count"),
            lead["facts"].alias("facts"),
        )

    # One row per finding that fires.
    candidates = [
        (
            "PS_ORPHANED_SCRIPTBLOCK_001",
            orphaned,
            finding(
                "PS_ORPHANED_SCRIPTBLOCK_001",
                c("start"),
                c("first_start"),
                text("ScriptBlock %s… started but never completed — possible forced termination", short_id),
                {
                    "script_block_id": c("block_id"),
                    "runspace_id": c("start")["runspace_id"],
                    "hostname": c("start")["hostname"],
                },
                1,
            ),
        ),
        (
            "PS_CONFIRMED_SUSPICIOUS_EXEC_001",
            confirmed,
            finding(
                "PS_CONFIRMED_SUSPICIOUS_EXEC_001",
                c("logged"),
                c("first_logged"),
                text(
                    "Suspicious script block %s… confirmed executed (4104+4105 correlation). Patterns: %s",
                    short_id,
                    shown,
                ),
                {
                    "script_block_id": c("block_id"),
                    "runspace_id": c("logged")["runspace_id"],
                    "matched_patterns": F.to_json(patterns),
                    "text_preview": F.substring(script, 1, 300),
                },
                2,
            ),
        ),
    ]
    chosen = [F.when(cond, body) for rule_id, cond, body in candidates if wanted is None or rule_id in wanted]
    rows = per_block.withColumn("_f", F.explode(F.array_compact(F.array(*chosen)))).select(
        "collection_id", "channel", "block_id", "start", "logged", "_f.*"
    )
    is_orphan = c("rule_id") == "PS_ORPHANED_SCRIPTBLOCK_001"
    rows = rows.withColumn(
        "id", x.stable_id(c("collection_id"), c("channel"), c("rule_id"), c("block_id"))
    ).withColumn(
        "logon_id",
        F.when(is_orphan, c("start")["logon_id"]).otherwise(
            F.coalesce(c("logged")["logon_id"], c("start")["logon_id"])
        ),
    )
    catalog = F.broadcast(rule_catalog(view.sparkSession))
    findings = rows.join(catalog, "rule_id").select(
        "collection_id",
        "channel",
        "id",
        F.struct(
            c("channel").alias("channel"),
            F.lit(1).alias("phase"),
            c("rule_no").cast("bigint").alias("a"),
            c("first_ord").alias("b"),
        ).alias("ord"),
        "timestamp",
        "rule_id",
        "rule_name",
        "rule_type",
        F.array().cast(CAP_LIST).alias("requires"),
        F.array().cast(CAP_LIST).alias("provides"),
        F.array().cast(KEY_LIST).alias("fusion_key"),
        "severity",
        "confidence",
        "technique_id",
        "technique_name",
        "tactic",
        "kill_chain_phase",
        "tags",
        "source",
        "description",
        "event_count",
        with_logon_entry(c("extra"), c("logon_id")).alias("extra"),
        empty.alias("entities"),
        "logon_id",
        F.when(is_orphan, c("start")["is_probe"])
        .otherwise(c("start")["is_probe"] | c("logged")["is_probe"])
        .alias("is_probe"),
        "facts",
    )
    ids = F.when(is_orphan, F.array(c("start")["id"])).otherwise(
        F.array(c("logged")["id"], c("start")["id"])
    )
    triggers = rows.select(
        "collection_id", "channel", c("id").alias("finding_id"), F.posexplode(ids).alias("ord", "event_id")
    ).select("collection_id", "channel", "finding_id", "event_id", "ord", x.null_string().alias("value"))
    return Findings(findings, triggers)


# ------------------------------------------------------------------ login after failures
def login_attempts(view: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Form logins of each address with their outcome.

    An attempt succeeded if the address's next request is away from the login page; a last
    request without a successor counts as a failure.
    """
    requests = view.where(c("has_url") & c("has_http") & x.non_empty(c("src_ip")).isNotNull())
    requests = requests.select(
        "collection_id",
        "channel",
        "ord",
        "id",
        "event_time",
        "created",
        "src_ip",
        "method",
        "status",
        "url_path",
        "guid",
        "pid",
        "parent_guid",
        "parent_pid",
        "process",
        "raw_user_name",
        "own_logon_id",
        "is_probe",
    )
    paired = with_next(
        requests,
        ["collection_id", "channel", "src_ip"],
        "created",
        "ord",
        ["url_path"],
        bucket_seconds=bucket_seconds,
    )
    attempts = paired.where(
        c("url_path").contains(fv.LOGIN_PATH) & (c("method") == "post") & (c("status") == 302)
    )
    succeeded = c("next").isNotNull() & ~c("next")["url_path"].contains(fv.LOGIN_PATH)
    return attempts.withColumn("succeeded", succeeded).drop("next")


def login_findings(view: DataFrame, bucket_seconds: int = 3600):
    """First success of an address that follows at least three failures."""
    from casegraph.plans.detect import Findings, with_logon, with_logon_entry

    keys = ["collection_id", "channel", "src_ip"]
    # Attempts are used several times below: one narrow stage table instead of as many plans.
    needed = [
        *keys, "id", "created", "ord", "own_logon_id", "is_probe", "succeeded", "event_time", "guid", "pid",
        "parent_guid", "parent_pid", "process", "raw_user_name",
    ]
    attempts = with_logon(login_attempts(view, bucket_seconds).select(*needed), view)
    at = F.struct(c("created").alias("t"), c("ord").alias("o"))
    with shuffles_given_back(view.sparkSession):
        attempts = cut_lineage(attempts.withColumn("at", at))
    failures = attempts.where(~c("succeeded"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("at"))
    # row_number <= k is evaluated as a partial top-k before the shuffle.
    third = (
        failures.withColumn("nth", nth)
        .where(c("nth") <= fv.LOGIN_FAILURES_BEFORE_SUCCESS)
        .groupBy(*keys)
        .agg(F.max("nth").alias("seen"), F.max("at").alias("third_at"))
        .where(c("seen") == fv.LOGIN_FAILURES_BEFORE_SUCCESS)
        .drop("seen")
    )
    success_item = F.struct(
        "at", "id", "created", "ord", "logon_id", "is_probe", facts(c("src_ip")).alias("facts")
    )
    first_success = (
        attempts.where(c("succeeded"))
        .join(third, keys)
        .where(c("at") > c("third_at"))
        .groupBy(*keys)
        .agg(F.min(success_item).alias("success"))
    )
    prior = failures.join(first_success, keys).where(c("at") < c("success")["at"])
    counts = prior.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_count"))
    newest_first = F.row_number().over(W.partitionBy(*keys).orderBy(c("at").desc()))
    last_failures = prior.withColumn("back", newest_first).where(
        c("back") <= fv.LOGIN_FAILURE_TRIGGERS
    )
    # At most ten failures per address reach this aggregation.
    kept = last_failures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kept"),
        F.min(F.struct("at", facts(c("src_ip")).alias("facts")))["facts"].alias("facts"),
        F.min(F.when(c("logon_id").isNotNull(), F.struct("at", "logon_id")))["logon_id"].alias(
            "failure_logon"
        ),
        F.max("is_probe").alias("failure_probe"),
    )
    rule_id = "WEB_LOGIN_SUCCESS_AFTER_BF_001"
    rows = (
        first_success.join(counts, keys)
        .join(kept, keys)
        .withColumn("id", x.stable_id(c("collection_id"), c("channel"), F.lit(rule_id), c("src_ip")))
        .withColumn("rule_id", F.lit(rule_id))
        .withColumn("logon_id", F.coalesce("failure_logon", c("success")["logon_id"]))
    )
    credential = partial(capability, source_ip=c("src_ip"))
    findings = rows.join(F.broadcast(rule_catalog(view.sparkSession)), "rule_id").select(
        "collection_id",
        "channel",
        "id",
        F.struct(
            c("channel").alias("channel"),
            F.lit(1).alias("phase"),
            c("rule_no").cast("bigint").alias("a"),
            c("success")["ord"].alias("b"),
        ).alias("ord"),
        c("success")["created"].alias("timestamp"),
        "rule_id",
        "rule_name",
        "rule_type",
        F.array(credential("credential_candidate")).cast(CAP_LIST).alias("requires"),
        F.array(credential("valid_credential")).cast(CAP_LIST).alias("provides"),
        F.array().cast(KEY_LIST).alias("fusion_key"),
        "severity",
        "confidence",
        "technique_id",
        "technique_name",
        "tactic",
        "kill_chain_phase",
        "tags",
        "source",
        text("Login success on /login.php from %s after %s failed attempts", c("src_ip"), c("failed_count")).alias(
            "description"
        ),
        (c("kept") + 1).alias("event_count"),
        with_logon_entry(
            x.string_map(source_ip=c("src_ip"), failed_count=c("failed_count")), c("logon_id")
        ).alias("extra"),
        x.string_map(source_ip=c("src_ip")).alias("entities"),
        "logon_id",
        (c("failure_probe") | c("success")["is_probe"]).alias("is_probe"),
        "facts",
    )
    ids = rows.select(*keys, c("id").alias("finding_id"))
    failure_triggers = last_failures.join(ids, keys).select(
        "collection_id", "channel", "finding_id", c("id").alias("event_id"), "ord", x.null_string().alias("value")
    )
    success_triggers = rows.select(
        "collection_id",
        "channel",
        c("id").alias("finding_id"),
        c("success")["id"].alias("event_id"),
        c("success")["ord"].alias("ord"),
        x.null_string().alias("value"),
    )
    return Findings(findings, failure_triggers.unionByName(success_triggers))


# ------------------------------------------------------------------ registry of set rules
_SCRIPT_RULES = {"PS_ORPHANED_SCRIPTBLOCK_001", "PS_CONFIRMED_SUSPICIOUS_EXEC_001"}
_LOGIN_RULES = {"WEB_LOGIN_SUCCESS_AFTER_BF_001"}
_GROUP_RULES = {
    "WIN_BRUTE_FORCE_001",
    "NET_ARP_POISONING_001",
    "WIN_MASS_FILE_DELETE_001",
    "WEB_BRUTE_FORCE_001",
    "WEB_RECON_SCAN_001",
    "WEB_SCANNER_UA_001",
}


def default_set_rules() -> dict[str, Callable]:
    """Jobs, not single rules: rules that can share a scan and a shuffle do."""
    return {
        "group_rules": group_findings,
        "script_blocks": script_block_findings,
        "login_after_failures": login_findings,
    }


def rules_of(name: str, job: Callable) -> list[str]:
    """The rules of a job, in order; a job of its own is one rule."""
    known = {"group_rules": _GROUP_RULES, "script_blocks": _SCRIPT_RULES}.get(name)
    if known is None:
        return [name]
    wanted = getattr(job, "keywords", {}).get("wanted") or known
    return sorted(wanted)


def select_set_rules(rules: dict[str, Callable], wanted: set[str]) -> dict[str, Callable]:
    chosen: dict[str, Callable] = {}
    for name, job in rules.items():
        if name == "group_rules":
            if wanted & _GROUP_RULES:
                chosen[name] = partial(group_findings, wanted=wanted & _GROUP_RULES)
        elif name == "script_blocks":
            if wanted & _SCRIPT_RULES:
                chosen[name] = partial(script_block_findings, wanted=wanted & _SCRIPT_RULES)
        elif name == "login_after_failures":
            if wanted & _LOGIN_RULES:
                chosen[name] = job
        elif name in wanted:
            chosen[name] = job
    return chosen


__all__ = ["GroupRule", "RULE_NUMBER", "default_set_rules", "group_findings", "login_findings"]
