"""Queries: jobs, policies, rules, decisions, grants, console views, scoring and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.catalog import derived as dv
from veilscan.catalog.derived import HITS, JOBS, STORED_POLICIES, with_
from veilscan.catalog.registry import query
from veilscan.functions.policy import expand_mode, mode_of, policy_faults
from veilscan.operators import access as ac
from veilscan.operators import alerts as al
from veilscan.operators import console as co
from veilscan.operators import lifecycle as lc
from veilscan.operators import policies as po
from veilscan.operators import rule_admin as ra
from veilscan.operators import scoring as sc
from veilscan.session import shared_dir
from veilscan.sources import documents as src
from veilscan.sources.rules import duplicate_ids

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def text_of(column: str):
    return F.date_format(column, STAMP).alias(column)


def sql_text(column: str) -> str:
    return f'strftime("{column}", {SQL_STAMP}) AS "{column}"'


# --- policies --------------------------------------------------------------------------


@query("policy_per_job", with_(STORED_POLICIES) + "SELECT doc_id AS job_id, deep_scan_required, fail_mode, on_unreadable, tags FROM documents JOIN policies ON source = queue")
def policy_per_job(t):
    """Stored policy, else file policy, else default, for every document's queue."""
    jobs = t.documents.select(F.col("doc_id").alias("job_id"), F.col("source").alias("queue"))
    found = po.with_policy(jobs, dv.stored_policies(t), po.with_defaults(dv.file_overrides(t)))
    return found.select(
        "job_id", "policy.deep_scan_required", "policy.fail_mode", "policy.on_unreadable", F.array_join("policy.rule_tags", ",").alias("tags")
    )


@query("policy_file_overlay", with_(STORED_POLICIES) + "SELECT * FROM from_file")
def policy_file_overlay(t):
    return po.with_defaults(dv.file_overrides(t)).withColumn("tags", F.array_join("rule_tags", ",")).drop("rule_tags")


# Customers stand in for queues where many are needed.
QUEUES = """
stored AS (
  SELECT 'queue-' || c_custkey AS queue, c_custkey % 2 = 0 AS deep_scan_required, CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'open' END AS fail_mode,
    CASE c_custkey % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'log' WHEN 2 THEN 'block' ELSE 'allow' END AS on_unreadable, c_custkey AS n
  FROM customer WHERE c_custkey % 5 <> 4),
live AS (SELECT 'queue-' || c_custkey || CASE WHEN c_custkey % 10 = 9 THEN '-device' ELSE '' END AS queue,
    CASE WHEN c_custkey % 3 = 0 THEN 'socket://10.0.0.1' WHEN c_custkey % 3 = 1 THEN 'warden://ipp/host-' || c_custkey || '/print' ELSE 'warden://lpd' END AS uri
  FROM customer WHERE c_custkey % 7 <> 3)"""


def stored_queues(t):
    n = F.col("c_custkey")
    return t.customer.filter(n % 5 != 4).select(
        F.concat(F.lit("queue-"), n.cast("string")).alias("queue"), (n % 2 == 0).alias("deep_scan_required"),
        F.when(n % 3 == 0, "closed").otherwise("open").alias("fail_mode"),
        F.when(n % 4 == 0, "hold").when(n % 4 == 1, "log").when(n % 4 == 2, "block").otherwise("allow").alias("on_unreadable"),
        F.array(F.lit("*")).alias("rule_tags"),
    )


def live_queues(t):
    n = F.col("c_custkey")
    return t.customer.filter(n % 7 != 3).select(
        F.concat(F.lit("queue-"), n.cast("string"), F.when(n % 10 == 9, "-device").otherwise("")).alias("queue"),
        F.when(n % 3 == 0, "socket://10.0.0.1").when(n % 3 == 1, F.concat(F.lit("warden://ipp/host-"), n.cast("string"), F.lit("/print")))
        .otherwise("warden://lpd").alias("uri"),
    )


@query(
    "queues_adopted",
    with_(QUEUES) + "SELECT l.queue, split_part(substring(uri, 10), '/', 1) || '://' || CASE WHEN contains(substring(uri, 10), '/') THEN substring(substring(uri, 10), strpos(substring(uri, 10), '/') + 1) ELSE '' END AS device_uri FROM live l LEFT JOIN stored s USING (queue) WHERE s.queue IS NULL AND starts_with(uri, 'warden://') AND NOT ends_with(l.queue, '-device')",
)
def queues_adopted(t):
    return po.adopt(live_queues(t), stored_queues(t), "warden")


@query(
    "queues_reconciled",
    with_(QUEUES) + "SELECT coalesce(s.queue, l.queue) AS queue, CASE WHEN l.queue IS NULL THEN 'missing' WHEN s.queue IS NULL THEN 'unmanaged' ELSE 'managed' END AS status FROM stored s FULL JOIN live l ON s.queue = l.queue",
)
def queues_reconciled(t):
    return po.reconcile(stored_queues(t), live_queues(t))


@query("queues_missing", with_(QUEUES) + "SELECT queue FROM stored EXCEPT SELECT queue FROM live")
def queues_missing(t):
    return po.missing_names(stored_queues(t), live_queues(t))


@query("policies_seeded", with_(QUEUES) + "SELECT l.queue, 'external' AS status FROM live l ANTI JOIN stored s USING (queue)")
def policies_seeded(t):
    incoming = live_queues(t).select("queue", F.lit("external").alias("status"))
    return po.seed(stored_queues(t), incoming, "queue")


@query(
    "policy_modes",
    with_(QUEUES) + "SELECT queue, CASE WHEN deep_scan_required AND on_unreadable = 'hold' THEN 'enforce' WHEN NOT deep_scan_required AND on_unreadable = 'log' THEN 'monitor' ELSE 'custom' END AS mode FROM stored",
)
def policy_modes(t):
    return stored_queues(t).select("queue", mode_of(F.col("deep_scan_required"), F.col("on_unreadable")).alias("mode"))


POLICY_CHANGES = """
changes AS (
  SELECT 'queue-' || c_custkey AS queue, CASE c_custkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS change, 'user' || c_nationkey AS actor,
    CASE c_custkey % 6 WHEN 2 THEN 'enforce' WHEN 3 THEN 'monitor' WHEN 4 THEN 'custom' WHEN 0 THEN 'weird' END AS mode,
    CASE WHEN c_custkey % 11 = 0 THEN true END AS deep_scan_required,
    CASE c_custkey % 9 WHEN 1 THEN 'closed' WHEN 2 THEN 'ajar' END AS fail_mode,
    CASE c_custkey % 8 WHEN 1 THEN 'allow' WHEN 2 THEN 'explode' END AS on_unreadable
  FROM customer),
busy AS (SELECT 'queue-' || o_custkey AS queue, count(*) AS held FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
judged AS (
  SELECT c.*, s.queue IS NOT NULL AS known, s.deep_scan_required AS o_deep, s.fail_mode AS o_fail, s.on_unreadable AS o_unr, coalesce(held, 0) AS held,
    concat_ws(',', CASE WHEN mode = 'weird' THEN 'mode' END, CASE WHEN c.fail_mode = 'ajar' THEN 'fail_mode' END, CASE WHEN c.on_unreadable = 'explode' THEN 'on_unreadable' END) AS faults
  FROM changes c LEFT JOIN stored s USING (queue) LEFT JOIN busy USING (queue)),
outcomes AS (
  SELECT *, CASE WHEN change = 'create' AND known THEN 'exists' WHEN change <> 'create' AND NOT known THEN 'unknown queue' WHEN change = 'delete' AND held > 0 THEN 'jobs held'
    WHEN change <> 'delete' AND faults <> '' THEN 'bad ' || faults ELSE 'applied' END AS outcome,
    CASE WHEN change = 'delete' THEN o_deep ELSE coalesce(deep_scan_required, CASE mode WHEN 'enforce' THEN true WHEN 'monitor' THEN false END, o_deep, false) END AS n_deep,
    CASE WHEN change = 'delete' THEN o_fail ELSE coalesce(fail_mode, o_fail, 'open') END AS n_fail,
    CASE WHEN change = 'delete' THEN o_unr ELSE coalesce(on_unreadable, CASE mode WHEN 'enforce' THEN 'hold' WHEN 'monitor' THEN 'log' END, o_unr, 'log') END AS n_unr
  FROM judged)"""


def policy_changes(t):
    n = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("queue-"), n.cast("string")).alias("queue"),
        F.when(n % 4 == 0, "create").when(n % 4 == 1, "delete").otherwise("update").alias("change"),
        F.concat(F.lit("user"), F.col("c_nationkey").cast("string")).alias("actor"), F.lit(0).alias("at"),
        F.when(n % 6 == 2, "enforce").when(n % 6 == 3, "monitor").when(n % 6 == 4, "custom").when(n % 6 == 0, "weird").alias("mode"),
        F.when(n % 11 == 0, True).alias("deep_scan_required"),
        F.when(n % 9 == 1, "closed").when(n % 9 == 2, "ajar").alias("fail_mode"),
        F.when(n % 8 == 1, "allow").when(n % 8 == 2, "explode").alias("on_unreadable"),
        F.lit(None).cast("array<string>").alias("rule_tags"),
    )


def busy_jobs(t):
    return t.orders.filter("o_orderstatus = 'O'").select(
        F.concat(F.lit("queue-"), F.col("o_custkey").cast("string")).alias("queue"), F.lit("held").alias("state")
    )


@query("policy_change_outcomes", with_(QUEUES, POLICY_CHANGES) + "SELECT queue, change, actor, outcome FROM outcomes")
def policy_change_outcomes(t):
    _, revisions = po.apply_changes(stored_queues(t), policy_changes(t), busy_jobs(t))
    return revisions.select("queue", "change", "actor", "outcome")


@query(
    "policies_after_changes",
    with_(QUEUES, POLICY_CHANGES)
    + """SELECT queue, deep_scan_required, fail_mode, on_unreadable FROM stored ANTI JOIN (SELECT queue FROM outcomes WHERE outcome = 'applied') USING (queue)
UNION ALL SELECT queue, n_deep, n_fail, n_unr FROM outcomes WHERE outcome = 'applied' AND change <> 'delete'""",
)
def policies_after_changes(t):
    after, _ = po.apply_changes(stored_queues(t), policy_changes(t), busy_jobs(t))
    return after.drop("rule_tags")


@query("policy_faults", with_(QUEUES, POLICY_CHANGES) + "SELECT queue, faults FROM judged WHERE faults <> ''")
def policy_fault_rows(t):
    return policy_changes(t).select(
        "queue", F.array_join(policy_faults(F.col("mode"), F.col("fail_mode"), F.col("on_unreadable")), ",").alias("faults")
    ).filter("faults <> ''")


@query("policy_mode_expansion", with_(QUEUES, POLICY_CHANGES) + "SELECT queue, coalesce(coalesce(on_unreadable, CASE mode WHEN 'enforce' THEN 'hold' WHEN 'monitor' THEN 'log' END), '') AS asked FROM changes")
def policy_mode_expansion(t):
    return policy_changes(t).select(
        "queue", F.coalesce(expand_mode(F.col("mode"), "on_unreadable", F.col("on_unreadable")), F.lit("")).alias("asked")
    )


REVISIONS = """
revisions AS (
  SELECT event_id AS revision_id, 'rule-' || user_id AS id, ts AS "at", 'user' || (event_id % 7) AS actor,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'updated' WHEN 'click' THEN 'enabled' WHEN 'error' THEN 'disabled' ELSE 'deleted' END AS change,
    round(value, 2) AS level FROM events)"""


def revisions(t, key="id"):
    e = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("revision_id"), F.concat(F.lit("rule-"), F.col("user_id").cast("string")).alias(key), F.col("ts").alias("at"),
        F.concat(F.lit("user"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        F.when(e == "signup", "created").when(e == "view", "updated").when(e == "click", "enabled").when(e == "error", "disabled").otherwise("deleted").alias("change"),
        F.round("value", 2).alias("level"),
    )


NEWEST_REVISION = 'newest AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, revision_id DESC) = 1)'


@query("latest_rule_revisions", with_(REVISIONS, NEWEST_REVISION) + "SELECT id, revision_id, actor, change, level FROM newest WHERE change <> 'deleted'")
def latest_rule_revisions(t):
    return po.latest(revisions(t), "id", ("at", "revision_id")).drop("at")


@query("latest_policy_revisions", with_(REVISIONS, NEWEST_REVISION) + "SELECT id AS queue, revision_id, actor, change, level FROM newest WHERE change <> 'deleted'")
def latest_policy_revisions(t):
    return po.latest(revisions(t, "queue"), "queue", ("at", "revision_id")).drop("at")


@query("revisions_newest", with_(REVISIONS) + "SELECT revision_id, id, actor, change FROM revisions ORDER BY \"at\" DESC, revision_id LIMIT 100")
def revisions_newest(t):
    return co.revisions_view(revisions(t), "id").select("revision_id", "id", "actor", "change")


@query("revisions_of_one_queue", with_(REVISIONS) + "SELECT revision_id, id AS queue, actor, change FROM revisions WHERE id = 'rule-7' ORDER BY \"at\" DESC, revision_id LIMIT 200")
def revisions_of_one_queue(t):
    return co.revisions_view(revisions(t, "queue"), "queue", "rule-7").select("revision_id", "queue", "actor", "change")


@query("rules_version", "SELECT count(*) AS n, epoch_us(max(ts)) AS latest FROM events")
def rules_version(t):
    return po.version(t.events, "ts").select("n", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest"))


# --- rules table -----------------------------------------------------------------------

RULE_TABLE = """
rules AS (SELECT 'rule-' || p_partkey AS id, p_name AS name, (p_size % 13)::INT AS severity, CASE WHEN p_partkey % 9 = 0 THEN 'a(?=b)' WHEN p_partkey % 9 = 1 THEN '(x)\\1' ELSE p_type || '+' END AS pattern,
  p_partkey % 4 <> 0 AS enabled, p_size::DOUBLE / 64 AS threshold FROM part)"""
RULE_FIELDS = ("name", "severity", "pattern", "enabled", "threshold")


def rule_table(t):
    k = F.col("p_partkey")
    return t.part.select(
        F.concat(F.lit("rule-"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 13).cast("int").alias("severity"),
        F.when(k % 9 == 0, "a(?=b)").when(k % 9 == 1, "(x)\\1").otherwise(F.concat("p_type", F.lit("+"))).alias("pattern"),
        (k % 4 != 0).alias("enabled"), (F.col("p_size").cast("double") / 64).alias("threshold"),
    )


RULE_CHANGES = """
changes AS (
  SELECT 'rule-' || (s_suppkey * 7) AS id, CASE s_suppkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'enable' WHEN 3 THEN 'disable' WHEN 4 THEN 'delete' ELSE 'update' END AS change,
    CASE WHEN s_suppkey % 5 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 = 1 THEN (s_suppkey % 14)::INT END AS severity, CASE WHEN s_suppkey % 3 = 1 THEN 'new+' END AS pattern FROM supplier
  UNION ALL SELECT 'fresh-' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'create' ELSE 'update' END, s_name, (s_suppkey % 14)::INT, 'p' FROM supplier),
outcomes AS (
  SELECT c.id, change, CASE WHEN change = 'create' AND r.id IS NOT NULL THEN 'exists' WHEN change <> 'create' AND r.id IS NULL THEN 'unknown rule'
      WHEN change IN ('create', 'update') AND coalesce(c.severity, 0) NOT BETWEEN 0 AND 10 THEN 'bad severity' ELSE 'applied' END AS outcome,
    CASE WHEN change IN ('create', 'update') THEN coalesce(c.name, r.name) ELSE r.name END AS name,
    CASE WHEN change IN ('create', 'update') THEN coalesce(c.severity, r.severity) ELSE r.severity END AS severity,
    CASE WHEN change IN ('create', 'update') THEN coalesce(c.pattern, r.pattern) ELSE r.pattern END AS pattern,
    CASE change WHEN 'enable' THEN true WHEN 'disable' THEN false ELSE coalesce(r.enabled, true) END AS enabled,
    CASE WHEN change = 'create' THEN 0.75::DOUBLE ELSE r.threshold END AS threshold
  FROM changes c LEFT JOIN rules r ON r.id = c.id)"""


def rule_changes(t):
    k = F.col("s_suppkey")
    change = F.when(k % 6 == 0, "create").when(k % 6 == 2, "enable").when(k % 6 == 3, "disable").when(k % 6 == 4, "delete").otherwise("update")
    fixed = [F.lit(0).alias("at"), F.lit("admin").alias("actor"), F.lit(None).cast("boolean").alias("enabled")]
    first = t.supplier.select(
        F.concat(F.lit("rule-"), (k * 7).cast("string")).alias("id"), change.alias("change"),
        F.when(k % 5 == 0, F.col("s_name")).alias("name"), F.when(k % 4 == 1, (k % 14).cast("int")).alias("severity"),
        F.when(k % 3 == 1, "new+").alias("pattern"), F.when(change == "create", 0.75).alias("threshold"), *fixed,
    )
    second_change = F.when(k % 2 == 0, "create").otherwise("update")
    second = t.supplier.select(
        F.concat(F.lit("fresh-"), k.cast("string")).alias("id"), second_change.alias("change"),
        F.col("s_name").alias("name"), (k % 14).cast("int").alias("severity"), F.lit("p").alias("pattern"),
        F.when(second_change == "create", 0.75).alias("threshold"), *fixed,
    )
    return first.unionByName(second)


@query("rule_change_outcomes", with_(RULE_TABLE, RULE_CHANGES) + "SELECT id, change, outcome FROM outcomes")
def rule_change_outcomes(t):
    _, log = ra.apply_changes(rule_table(t), rule_changes(t), RULE_FIELDS)
    return log.select("id", "change", "outcome")


@query(
    "rules_after_changes",
    with_(RULE_TABLE, RULE_CHANGES)
    + "SELECT * FROM rules ANTI JOIN (SELECT id FROM outcomes WHERE outcome = 'applied') USING (id) UNION ALL SELECT id, name, severity, pattern, enabled, threshold FROM outcomes WHERE outcome = 'applied' AND change <> 'delete'",
)
def rules_after_changes(t):
    after, _ = ra.apply_changes(rule_table(t), rule_changes(t), RULE_FIELDS)
    return after


# A log with many changes of every rule or queue: users stand in for them, events for changes.
CHANGE_OF_EVENT = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN '{}' WHEN 'error' THEN '{}' ELSE CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'update' END END"


def change_of_event(click: str, error: str):
    e = F.col("event_type")
    return (
        F.when(e == "signup", "create").when(e == "view", "update").when(e == "click", click).when(e == "error", error)
        .otherwise(F.when(F.col("event_id") % 3 == 0, "delete").otherwise("update"))
    )


RULE_LOG = f"""
log AS (
  SELECT 'rule-' || user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, {CHANGE_OF_EVENT.format('enable', 'disable')} AS change,
    CASE WHEN event_id % 5 < 2 THEN 'name ' || event_id END AS name, CASE WHEN event_id % 4 = 1 THEN (event_id % 12)::INT END AS severity,
    CASE WHEN event_id % 3 = 1 THEN 'new+' END AS pattern FROM events),
states AS (
  SELECT l.id, 0::BIGINT AS i, any_value(r.id) IS NOT NULL AS here, any_value(name) AS name, any_value(severity) AS severity, any_value(pattern) AS pattern,
    any_value(enabled) AS enabled, any_value(threshold) AS threshold, '' AS outcome, 0::BIGINT AS event_id FROM (SELECT DISTINCT id FROM log) l LEFT JOIN rules r ON r.id = l.id GROUP BY l.id
  UNION ALL
  SELECT id, i, CASE WHEN outcome = 'applied' AND change IN ('create', 'delete') THEN change = 'create' ELSE here END,
    CASE WHEN outcome <> 'applied' OR change NOT IN ('create', 'update') THEN o_name ELSE coalesce(name, CASE WHEN here THEN o_name END) END,
    CASE WHEN outcome <> 'applied' OR change NOT IN ('create', 'update') THEN o_severity ELSE coalesce(severity, CASE WHEN here THEN o_severity END) END,
    CASE WHEN outcome <> 'applied' OR change NOT IN ('create', 'update') THEN o_pattern ELSE coalesce(pattern, CASE WHEN here THEN o_pattern END) END,
    CASE WHEN outcome <> 'applied' THEN o_enabled WHEN change = 'enable' THEN true WHEN change = 'disable' THEN false WHEN change = 'create' THEN true ELSE coalesce(o_enabled, true) END,
    CASE WHEN outcome = 'applied' AND change = 'create' THEN NULL ELSE o_threshold END, outcome, event_id
  FROM (SELECT l.*, s.here, s.name AS o_name, s.severity AS o_severity, s.pattern AS o_pattern, s.enabled AS o_enabled, s.threshold AS o_threshold,
      CASE WHEN change = 'create' AND here THEN 'exists' WHEN change <> 'create' AND NOT here THEN 'unknown rule'
        WHEN change IN ('create', 'update') AND coalesce(l.severity, 0) NOT BETWEEN 0 AND 10 THEN 'bad severity' ELSE 'applied' END AS outcome
    FROM states s JOIN log l ON l.id = s.id AND l.i = s.i + 1))"""


def rule_log(t):
    n = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("rule-"), F.col("user_id").cast("string")).alias("id"), F.col("ts").alias("at"), n, F.lit("admin").alias("actor"),
        change_of_event("enable", "disable").alias("change"), F.when(n % 5 < 2, F.concat(F.lit("name "), n.cast("string"))).alias("name"),
        F.when(n % 4 == 1, (n % 12).cast("int")).alias("severity"), F.when(n % 3 == 1, "new+").alias("pattern"),
        F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("double").alias("threshold"),
    )


def recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


@query("rule_log_outcomes", recursive(RULE_TABLE, RULE_LOG) + "SELECT id, event_id, outcome FROM states WHERE i > 0")
def rule_log_outcomes(t):
    """Outcome of every change of a log in which rules come and go many times."""
    return ra.apply_changes(rule_table(t), rule_log(t), RULE_FIELDS, ("at", "event_id"))[1].select("id", "event_id", "outcome")


@query(
    "rules_after_log",
    recursive(RULE_TABLE, RULE_LOG)
    + """, final AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)
SELECT id, name, severity, pattern, enabled, threshold FROM final WHERE here UNION ALL SELECT * FROM rules ANTI JOIN final USING (id)""",
)
def rules_after_log(t):
    """The rules table after that log, folded in the order of time."""
    return ra.apply_changes(rule_table(t), rule_log(t), RULE_FIELDS, ("at", "event_id"))[0]


POLICY_LOG = f"""
busy AS (SELECT 'queue-' || o_custkey AS queue, count(*) AS held FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
log AS (
  SELECT 'queue-' || user_id AS queue, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, {CHANGE_OF_EVENT.format('update', 'delete')} AS change,
    CASE event_id % 6 WHEN 2 THEN 'enforce' WHEN 3 THEN 'monitor' WHEN 4 THEN 'custom' WHEN 0 THEN 'weird' END AS mode, CASE WHEN event_id % 11 = 0 THEN true END AS deep_scan_required,
    CASE event_id % 9 WHEN 1 THEN 'closed' WHEN 2 THEN 'ajar' END AS fail_mode, CASE event_id % 8 WHEN 1 THEN 'allow' WHEN 2 THEN 'explode' END AS on_unreadable FROM events),
states AS (
  SELECT l.queue, 0::BIGINT AS i, any_value(s.queue) IS NOT NULL AS here, any_value(deep_scan_required) AS deep_scan_required, any_value(fail_mode) AS fail_mode,
    any_value(on_unreadable) AS on_unreadable, coalesce(any_value(held), 0) AS held, '' AS outcome, 0::BIGINT AS event_id
  FROM (SELECT DISTINCT queue FROM log) l LEFT JOIN stored s USING (queue) LEFT JOIN busy USING (queue) GROUP BY l.queue
  UNION ALL
  SELECT queue, i, CASE WHEN outcome = 'applied' AND change IN ('create', 'delete') THEN change = 'create' ELSE here END,
    CASE WHEN outcome <> 'applied' OR change = 'delete' THEN o_deep ELSE coalesce(deep_scan_required, CASE mode WHEN 'enforce' THEN true WHEN 'monitor' THEN false END, CASE WHEN here THEN o_deep END, false) END,
    CASE WHEN outcome <> 'applied' OR change = 'delete' THEN o_fail ELSE coalesce(fail_mode, CASE WHEN here THEN o_fail END, 'open') END,
    CASE WHEN outcome <> 'applied' OR change = 'delete' THEN o_unr ELSE coalesce(on_unreadable, CASE mode WHEN 'enforce' THEN 'hold' WHEN 'monitor' THEN 'log' END, CASE WHEN here THEN o_unr END, 'log') END,
    held, outcome, event_id
  FROM (SELECT l.*, s.here, s.held, s.deep_scan_required AS o_deep, s.fail_mode AS o_fail, s.on_unreadable AS o_unr,
      CASE WHEN change = 'create' AND here THEN 'exists' WHEN change <> 'create' AND NOT here THEN 'unknown queue' WHEN change = 'delete' AND held > 0 THEN 'jobs held'
        WHEN change <> 'delete' AND faults <> '' THEN 'bad ' || faults ELSE 'applied' END AS outcome
    FROM (SELECT *, concat_ws(',', CASE WHEN mode = 'weird' THEN 'mode' END, CASE WHEN fail_mode = 'ajar' THEN 'fail_mode' END, CASE WHEN on_unreadable = 'explode' THEN 'on_unreadable' END) AS faults FROM log) l
    JOIN states s ON l.queue = s.queue AND l.i = s.i + 1))"""


def policy_log(t):
    n = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("queue-"), F.col("user_id").cast("string")).alias("queue"), change_of_event("update", "delete").alias("change"),
        F.lit("admin").alias("actor"), F.col("ts").alias("at"), n,
        F.when(n % 6 == 2, "enforce").when(n % 6 == 3, "monitor").when(n % 6 == 4, "custom").when(n % 6 == 0, "weird").alias("mode"),
        F.when(n % 11 == 0, True).alias("deep_scan_required"), F.when(n % 9 == 1, "closed").when(n % 9 == 2, "ajar").alias("fail_mode"),
        F.when(n % 8 == 1, "allow").when(n % 8 == 2, "explode").alias("on_unreadable"), F.lit(None).cast("array<string>").alias("rule_tags"),
    )


@query("policy_log_outcomes", recursive(QUEUES, POLICY_LOG) + "SELECT queue, event_id, outcome FROM states WHERE i > 0")
def policy_log_outcomes(t):
    """Outcome of every change of a log in which queues come and go many times."""
    return po.apply_changes(stored_queues(t), policy_log(t), busy_jobs(t), ("at", "event_id"))[1].select("queue", "event_id", "outcome")


@query(
    "policies_after_log",
    recursive(QUEUES, POLICY_LOG)
    + """, final AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY queue ORDER BY i DESC) = 1)
SELECT queue, deep_scan_required, fail_mode, on_unreadable FROM final WHERE here
UNION ALL SELECT queue, deep_scan_required, fail_mode, on_unreadable FROM stored ANTI JOIN final USING (queue)""",
)
def policies_after_log(t):
    """The stored policies after that log, folded in the order of time."""
    return po.apply_changes(stored_queues(t), policy_log(t), busy_jobs(t), ("at", "event_id"))[0].drop("rule_tags")


@query("rules_seeded", with_(RULE_TABLE) + "SELECT c.id, c.name FROM (SELECT 'rule-' || (s_suppkey * 31) AS id, s_name AS name FROM supplier) c ANTI JOIN rules USING (id)")
def rules_seeded(t):
    incoming = t.supplier.select(F.concat(F.lit("rule-"), (F.col("s_suppkey") * 31).cast("string")).alias("id"), F.col("s_name").alias("name"))
    return po.seed(rule_table(t), incoming, "id")


@query("rule_value_faults", with_(RULE_TABLE) + "SELECT id, 'severity' AS fault FROM rules WHERE severity > 10 UNION ALL SELECT id, 'pattern' FROM rules WHERE contains(pattern, '(?=') OR contains(pattern, '\\1')")
def rule_value_faults(t):
    return ra.value_faults(rule_table(t))


# Patterns that loading accepts, and ones it refuses: outside the dialect, invalid, or exponential.
FINE = (r"(?P<word>confidential)", r"\Qa.b\E", r"\x{41}", r"(?U)a+", r"a(?i)b", r"(?:a|b)*c")
REFUSED = (r"(?:a|aa)+$", r"((?:a+))+$", r"(\w+\s?)*$", r"(a|b|ab)*c", r"(a*)*b", r"a(?=b)", r"(x)\1", r"(?P<x>a)(?P<x>b)", r"(unclosed", r"a++")
PATTERNS = FINE + REFUSED


def quoted_pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


@query(
    "rule_pattern_faults",
    "SELECT 'rule-' || p_partkey AS id, p.pattern FROM part JOIN (VALUES "
    + ", ".join(f"({n}, {quoted_pattern(p)})" for n, p in enumerate(PATTERNS) if p in REFUSED)
    + f") p(n, pattern) ON p_partkey % {len(PATTERNS)} = p.n",
)
def rule_pattern_faults(t):
    """Rules whose pattern loading refuses, each part with one of a list of patterns."""
    n = F.col("p_partkey") % len(PATTERNS)
    table = t.part.select(
        F.concat(F.lit("rule-"), F.col("p_partkey").cast("string")).alias("id"), F.lit(5).alias("severity"),
        F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (n + 1).cast("int")).alias("pattern"),
    )
    return ra.value_faults(table).join(table, "id").select("id", "pattern")


@query("rules_view", with_(RULE_TABLE) + "SELECT id, name, severity, enabled FROM rules ORDER BY enabled DESC, severity DESC, id")
def rules_view(t):
    return co.rules_view(rule_table(t)).select("id", "name", "severity", "enabled")


@query("rule_duplicates", "SELECT 'rule-' || p_size AS id, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1 HAVING count(*) > 1")
def rule_duplicates(t):
    return duplicate_ids(t.part.select(F.concat(F.lit("rule-"), F.col("p_size").cast("string")).alias("id"), (F.col("p_partkey") % 4 != 0).alias("enabled")))


@query(
    "rule_snapshots",
    with_(RULE_TABLE) + "SELECT id, CASE WHEN substring(id, 6)::INT % 5 = 0 THEN 'unnamed' ELSE name END AS name, CASE WHEN substring(id, 6)::INT % 3 = 0 THEN 5 ELSE severity END AS severity, pattern FROM rules",
)
def rule_snapshots(t):
    """Rules to JSON and back; parts missing from a snapshot come back as defaults."""
    n = F.substr("id", F.lit(6)).cast("int")
    partial = rule_table(t).withColumns(
        {"name": F.when(n % 5 != 0, F.col("name")), "severity": F.when(n % 3 != 0, F.col("severity"))}
    )
    return ra.restore(ra.snapshot(partial, ("name", "severity", "pattern")), "name string, severity int, pattern string", {"name": "unnamed", "severity": 5})


# --- jobs ------------------------------------------------------------------------------

SUBMITTED = """
unpurged AS (SELECT * FROM jobs WHERE NOT purged QUALIFY row_number() OVER (PARTITION BY queue, cups_job_id, content_sha256 ORDER BY created_at DESC, job_id DESC) = 1),
submissions AS (SELECT c_custkey AS submission, 'q' || (c_custkey % 9) AS queue, (c_custkey % 97)::VARCHAR AS cups_job_id, 'body-' || (c_custkey % 6) AS content_sha256 FROM customer),
routed AS (SELECT s.*, u.job_id AS reused_id FROM submissions s LEFT JOIN unpurged u USING (queue, cups_job_id, content_sha256))"""


def reinspected(t):
    k = F.col("c_custkey")
    submissions = t.customer.select(
        k.alias("submission"), F.concat(F.lit("q"), (k % 9).cast("string")).alias("queue"), (k % 97).cast("string").alias("cups_job_id"),
        F.concat(F.lit("body-"), (k % 6).cast("string")).alias("content_sha256"), F.lit(0).alias("at"),
    )
    jobs = dv.jobs(t).withColumn("purged_at", F.when(F.col("purged"), F.col("created_at")))
    return lc.reinspect(jobs, dv.hits(t), submissions)


@query("newest_unpurged_job", with_(JOBS, SUBMITTED) + f"SELECT queue, cups_job_id, content_sha256, job_id, {sql_text('created_at')} FROM unpurged")
def newest_unpurged_job(t):
    found = lc.newest_per(
        dv.jobs(t).filter("not purged").select("queue", "cups_job_id", "content_sha256", "job_id", "created_at"), lc.SAME_DOCUMENT, ["created_at", "job_id"]
    )
    return found.withColumn("created_at", F.date_format("created_at", STAMP))


@query("reinspection_routing", with_(JOBS, SUBMITTED) + "SELECT submission, coalesce(reused_id, -1) AS reused_id FROM routed")
def reinspection_routing(t):
    return reinspected(t)[0].select("submission", F.coalesce("reused_id", F.lit(-1)).alias("reused_id"))


@query("reinspection_hits_kept", with_(JOBS, HITS, SUBMITTED) + "SELECT job_id, count(*) AS n FROM hits ANTI JOIN (SELECT reused_id AS job_id FROM routed) USING (job_id) GROUP BY job_id")
def reinspection_hits_kept(t):
    return reinspected(t)[1].groupBy("job_id").agg(F.count("*").alias("n"))


# Events as submissions: many of one document within the batch, some of stored documents, some without a full key.
BATCH = """
unpurged AS (SELECT * FROM jobs WHERE NOT purged QUALIFY row_number() OVER (PARTITION BY queue, cups_job_id, content_sha256 ORDER BY created_at DESC, job_id DESC) = 1),
subs AS (SELECT event_id AS submission, 1000000000 + event_id AS job_id, ts AS "at", 'q' || (user_id % 9) AS queue, CASE WHEN event_id % 13 <> 0 THEN (user_id % 97)::VARCHAR END AS cups_job_id,
    'body-' || (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 5 ELSE 6 END) AS content_sha256, 'user' || user_id AS username FROM events),
firsts AS (SELECT queue, cups_job_id, content_sha256, submission AS first_sub, job_id AS first_job FROM subs WHERE cups_job_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY queue, cups_job_id, content_sha256 ORDER BY "at", submission) = 1),
merged AS (SELECT s.*, coalesce(u.job_id, f.first_job, s.job_id) AS target, u.job_id IS NULL AND coalesce(first_sub, submission) = submission AS makes
  FROM subs s LEFT JOIN unpurged u USING (queue, cups_job_id, content_sha256) LEFT JOIN firsts f USING (queue, cups_job_id, content_sha256))"""


def merged_batch(t):
    e = F.col("event_type")
    subs = t.events.select(
        F.col("event_id").alias("submission"), (F.col("event_id") + 1000000000).alias("job_id"), F.col("ts").alias("at"),
        F.concat(F.lit("q"), (F.col("user_id") % 9).cast("string")).alias("queue"),
        F.when(F.col("event_id") % 13 != 0, (F.col("user_id") % 97).cast("string")).alias("cups_job_id"),
        F.concat(F.lit("body-"), F.when(e == "view", "0").when(e == "click", "1").when(e == "error", "5").otherwise("6")).alias("content_sha256"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
    )
    jobs = dv.jobs(t).withColumn("purged_at", F.when(F.col("purged"), F.col("created_at")))
    return lc.merge_submissions(jobs, dv.hits(t).select("job_id", "page"), dv.hits(t), subs)


@query(
    "jobs_after_reinspection",
    with_(JOBS, BATCH)
    + """SELECT job_id, queue, cups_job_id, content_sha256, username, CASE WHEN job_id IN (SELECT target FROM merged WHERE NOT makes) THEN 'inspecting' ELSE state END AS state FROM jobs
UNION ALL SELECT job_id, queue, cups_job_id, content_sha256, username, 'inspecting' FROM merged WHERE makes""",
)
def jobs_after_reinspection(t):
    """The jobs after a batch in which documents come again, some of them several times."""
    return merged_batch(t).jobs.select("job_id", "queue", "cups_job_id", "content_sha256", "username", "state")


@query("reinspection_batch_events", with_(JOBS, BATCH) + "SELECT target AS job_id, submission, 'CUPS re-ran the backend for this job' AS detail FROM merged WHERE NOT makes")
def reinspection_batch_events(t):
    return merged_batch(t).events.select("job_id", "submission", "detail")


@query(
    "pages_after_reinspection",
    with_(JOBS, HITS, BATCH) + "SELECT job_id, count(*) AS pages FROM hits ANTI JOIN (SELECT target AS job_id FROM merged WHERE NOT makes) USING (job_id) GROUP BY job_id",
)
def pages_after_reinspection(t):
    """Stored pages (those of hits stand in for them) after the same batch: old text of repeated jobs is gone."""
    return merged_batch(t).pages.groupBy("job_id").agg(F.count("*").alias("pages"))


@query(
    "preflight",
    with_(JOBS, "cleared AS (SELECT queue, cups_job_id, job_id, verdict_reason FROM jobs WHERE state = 'released_by_analyst' QUALIFY row_number() OVER (PARTITION BY queue, cups_job_id ORDER BY created_at DESC, job_id DESC) = 1)")
    + "SELECT c_custkey AS k, c.job_id IS NOT NULL AS pass_through, CASE WHEN c.job_id IS NULL THEN '' ELSE 'released by analyst: ' || verdict_reason END AS reason FROM customer LEFT JOIN cleared c ON c.queue = 'q' || (c_custkey % 9) AND c.cups_job_id = (c_custkey % 120)::VARCHAR",
)
def preflight(t):
    k = F.col("c_custkey")
    requests = t.customer.select(k.alias("k"), F.concat(F.lit("q"), (k % 9).cast("string")).alias("queue"), (k % 120).cast("string").alias("cups_job_id"))
    answers = lc.preflight(requests.select("queue", "cups_job_id").distinct(), dv.jobs(t))
    return requests.join(answers, ["queue", "cups_job_id"]).select("k", "pass_through", "reason")


DECISIONS = """
decisions AS (
  SELECT event_id AS decision_id, event_id % (SELECT count(*) FROM orders) AS job_id, ts AS "at", 'user' || (user_id % 5) AS actor, CASE WHEN event_type IN ('view', 'click') THEN 'deny' ELSE 'release' END AS verb,
    CASE event_id % 10 WHEN 3 THEN 'no' WHEN 4 THEN repeat('x', 1001) ELSE 'checked ' || event_id END AS reason
  FROM events),
d2 AS (SELECT decision_id, job_id // 3 * 3 AS job_id, "at", actor, verb, reason FROM decisions),
judged AS (SELECT d.*, j.state, CASE WHEN length(reason) NOT BETWEEN 3 AND 1000 THEN 'bad reason' WHEN j.state IS NULL THEN 'unknown job' WHEN j.state <> 'held' THEN 'job is ' || j.state || ', not held' END AS fault
  FROM d2 d LEFT JOIN jobs j USING (job_id)),
firsts AS (SELECT job_id, decision_id AS won, verb, reason FROM judged WHERE fault IS NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "at", decision_id) = 1)"""


def decided(t):
    total = t.orders.agg(F.count("*")).scalar()
    e = F.col("event_id")
    decisions = t.events.select(
        e.alias("decision_id"), (F.floor((e % total) / 3) * 3).alias("job_id"), F.col("ts").alias("at"),
        F.concat(F.lit("user"), (F.col("user_id") % 5).cast("string")).alias("actor"),
        F.when(F.col("event_type").isin("view", "click"), "deny").otherwise("release").alias("verb"),
        F.when(e % 10 == 3, "no").when(e % 10 == 4, F.repeat(F.lit("x"), 1001)).otherwise(F.concat(F.lit("checked "), e.cast("string"))).alias("reason"),
    )
    return lc.decide(dv.jobs(t), decisions)


@query("decision_outcomes", with_(JOBS, DECISIONS) + "SELECT decision_id, job_id, verb, actor, coalesce(fault, CASE WHEN won = decision_id THEN 'applied' ELSE 'already decided' END) AS outcome FROM (SELECT j.*, f.won FROM judged j LEFT JOIN firsts f USING (job_id))")
def decision_outcomes(t):
    return decided(t)[1].drop("at")


@query("jobs_after_decisions", with_(JOBS, DECISIONS) + "SELECT j.job_id, CASE f.verb WHEN 'release' THEN 'released_by_analyst' WHEN 'deny' THEN 'denied_by_analyst' ELSE j.state END AS state, coalesce(f.reason, j.verdict_reason) AS verdict_reason FROM jobs j LEFT JOIN firsts f USING (job_id)")
def jobs_after_decisions(t):
    return decided(t)[0].select("job_id", "state", "verdict_reason")


ARCHIVED = """
archived AS (SELECT job_id, created_at + to_days(90) AS purge_after, strftime(created_at, '%Y/%m/%d') || '/' || job_id || '.bin' AS archive_key, purged FROM jobs)"""
NOW = "1998-01-01 00:00:00"


def archived(t):
    return dv.jobs(t).select(
        "job_id", lc.purge_deadline(F.col("created_at")).alias("purge_after"), lc.archive_key(F.col("created_at"), F.col("job_id")).alias("archive_key"),
        F.when(F.col("purged"), F.col("created_at")).alias("purged_at"),
    )


@query("retention_batch", with_(JOBS, ARCHIVED) + f"SELECT job_id FROM archived WHERE NOT purged AND purge_after < TIMESTAMP '{NOW}' ")
def retention_batch(t):
    """All bodies that are due."""
    return lc.purge(archived(t), F.lit(NOW).cast("timestamp_ntz"))[1]


@query("retention_applied", with_(JOBS, ARCHIVED) + f"SELECT job_id, CASE WHEN NOT purged AND purge_after < TIMESTAMP '{NOW}' THEN '' ELSE archive_key END AS archive_key, purged OR purge_after < TIMESTAMP '{NOW}' AS is_purged FROM archived")
def retention_applied(t):
    after, _ = lc.purge(archived(t), F.lit(NOW).cast("timestamp_ntz"), limit=None)
    return after.select("job_id", "archive_key", F.col("purged_at").isNotNull().alias("is_purged"))


@query("retention_text_kept", with_(JOBS, HITS, ARCHIVED) + f"SELECT h.job_id, count(*) AS n FROM hits h JOIN archived a USING (job_id) WHERE purged OR purge_after >= TIMESTAMP '{NOW}' GROUP BY h.job_id")
def retention_text_kept(t):
    """Rows that stay when the text of purged jobs is removed (line items stand in for pages)."""
    _, gone = lc.purge(archived(t), F.lit(NOW).cast("timestamp_ntz"), limit=None)
    return lc.drop_text(dv.hits(t).select("job_id"), gone).groupBy("job_id").agg(F.count("*").alias("n"))


# --- grants ----------------------------------------------------------------------------

REQUESTS = """
requests AS (SELECT o_orderkey AS request_id, o_orderkey AS job_id, 'user' || (o_custkey % 50) AS requester, 'why ' || o_orderkey AS reason, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey % 43200) AS "at" FROM orders),
grants AS (SELECT r.request_id, r.job_id, requester, r.reason, "at" AS created_at, CASE WHEN purged THEN 'purged' ELSE 'pending' END AS status, "at" + to_hours(2) AS expires_at FROM requests r JOIN jobs USING (job_id)),
approvals AS (SELECT l_orderkey AS request_id, 'user' || (l_partkey % 50) AS approver, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(l_orderkey % 43200 + l_linenumber) AS "at" FROM lineitem GROUP BY ALL),
ajudged AS (SELECT a.*, CASE WHEN g.status IS NULL THEN 'not found' WHEN g.status <> 'pending' THEN 'already ' || g.status WHEN a.approver = g.requester THEN 'own request' ELSE 'approved' END AS outcome FROM approvals a LEFT JOIN grants g USING (request_id)),
afirst AS (SELECT request_id, "at" AS decided_at, approver AS decider FROM ajudged WHERE outcome = 'approved' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY "at", approver) = 1),
agrants AS (SELECT g.request_id, g.job_id, g.requester, g.created_at, CASE WHEN f.request_id IS NULL THEN g.status ELSE 'approved' END AS status, f.decider AS approver, f.decided_at, coalesce(f.decided_at + to_hours(2), g.expires_at) AS expires_at FROM grants g LEFT JOIN afirst f USING (request_id))"""


def granted(t):
    k, start = F.col("o_orderkey"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def later(minutes):
        return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))

    jobs = dv.jobs(t).withColumn("purged_at", F.when(F.col("purged"), F.col("created_at")))
    requests = t.orders.select(
        k.alias("request_id"), k.alias("job_id"), F.concat(F.lit("user"), (F.col("o_custkey") % 50).cast("string")).alias("requester"),
        F.concat(F.lit("why "), k.cast("string")).alias("reason"), later(k % 43200).alias("at"),
    )
    grants = ac.request(jobs, requests)
    approvals = t.lineitem.select(
        F.col("l_orderkey").alias("request_id"), F.concat(F.lit("user"), (F.col("l_partkey") % 50).cast("string")).alias("approver"),
        later(F.col("l_orderkey") % 43200 + F.col("l_linenumber")).alias("at"),
    ).distinct()
    return jobs, grants, *ac.approve(grants, approvals)


@query("grant_requests", with_(JOBS, REQUESTS) + f"SELECT request_id, job_id, requester, reason, status, CASE WHEN status = 'purged' THEN '' ELSE strftime(expires_at, {SQL_STAMP}) END AS expires_at FROM grants")
def grant_requests(t):
    return granted(t)[1].select("request_id", "job_id", "requester", "reason", "status", F.coalesce(F.date_format("expires_at", STAMP), F.lit("")).alias("expires_at"))


@query("grant_approval_outcomes", with_(JOBS, REQUESTS) + f"SELECT request_id, j.approver, strftime(j.\"at\", {SQL_STAMP}) AS \"at\", CASE WHEN outcome = 'approved' AND (j.\"at\" <> f.decided_at OR j.approver <> f.decider) THEN 'already approved' ELSE outcome END AS outcome FROM ajudged j LEFT JOIN afirst f USING (request_id)")
def grant_approval_outcomes(t):
    return granted(t)[3].withColumn("at", F.date_format("at", STAMP))


@query("grants_approved", with_(JOBS, REQUESTS) + f"SELECT request_id, status, approver, {sql_text('expires_at')} FROM agrants WHERE status = 'approved'")
def grants_approved(t):
    return granted(t)[2].filter("status = 'approved'").select("request_id", "status", "approver", text_of("expires_at"))


@query("grants_valid", with_(JOBS, REQUESTS) + "SELECT request_id, job_id, requester FROM agrants WHERE status = 'approved' AND expires_at > TIMESTAMP '2024-01-01 10:00:00'")
def grants_valid(t):
    return ac.valid_grants(granted(t)[2], F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).select("request_id", "job_id", "requester")


READS = """
reads AS (
  SELECT row_number() OVER (ORDER BY request_id, n) AS read_id, job_id, CASE WHEN n = 3 THEN 'stranger' ELSE requester END AS actor,
    CASE (request_id + n) % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'text' ELSE 'preview' END AS kind, created_at + to_minutes(n * 25) AS "at"
  FROM requests2, (VALUES (1), (2), (3), (4), (5), (6)) v(n)),
inside AS (SELECT r.*, g.request_id FROM reads r JOIN agrants g ON g.job_id = r.job_id AND g.requester = r.actor AND g.status = 'approved' AND r."at" >= g.decided_at AND r."at" < g.expires_at
  JOIN jobs j ON j.job_id = r.job_id WHERE NOT (r.kind = 'preview' AND j.state IN ('held', 'inspecting')) AND NOT (j.purged AND r.kind <> 'text')),
consumed AS (SELECT request_id, min("at") AS "at" FROM inside WHERE kind = 'content' GROUP BY request_id),
covered AS (SELECT i.read_id, i.request_id FROM inside i LEFT JOIN consumed c USING (request_id) WHERE c."at" IS NULL OR i."at" <= c."at"),
outcome AS (SELECT r.*, CASE WHEN j.purged AND r.kind <> 'text' THEN 'purged' WHEN (r.kind = 'preview' AND j.state IN ('held', 'inspecting')) OR c.request_id IS NOT NULL THEN 'allowed' ELSE 'approval required' END AS outcome,
    coalesce(c.request_id, -1) AS request_id FROM reads r JOIN jobs j USING (job_id) LEFT JOIN covered c USING (read_id))"""
READ_CTES = (JOBS, REQUESTS, "requests2 AS (SELECT * FROM grants)", READS)


def judged_reads(t):
    jobs, grants, approved, _ = granted(t)
    each = F.array(*[F.lit(n) for n in range(1, 7)])
    reads = grants.select("request_id", "job_id", "requester", "created_at", F.explode(each).alias("n")).select(
        F.struct("request_id", "n").alias("read_id"), "job_id",
        F.when(F.col("n") == 3, "stranger").otherwise(F.col("requester")).alias("actor"),
        F.when((F.col("request_id") + F.col("n")) % 3 == 0, "content").when((F.col("request_id") + F.col("n")) % 3 == 1, "text").otherwise("preview").alias("kind"),
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n") * 25)).alias("at"),
    ).withColumn("read_id", F.col("read_id.request_id") * 10 + F.col("read_id.n"))
    return approved, ac.read(jobs, approved, reads)


@query("content_reads", with_(*READ_CTES) + f"SELECT job_id, actor, kind, {sql_text('at')}, outcome, request_id FROM outcome")
def content_reads(t):
    """Every read judged against grants; a content read uses its grant up."""
    return judged_reads(t)[1].select("job_id", "actor", "kind", text_of("at"), "outcome", F.coalesce("request_id", F.lit(-1)).alias("request_id"))


@query(
    "grants_after_reads",
    with_(*READ_CTES) + f"""SELECT g.request_id, g.job_id, g.requester, g.status, coalesce(strftime(u."at", {SQL_STAMP}), '') AS used_at
FROM agrants g LEFT JOIN (SELECT request_id, min("at") AS "at" FROM outcome WHERE kind = 'content' AND outcome = 'allowed' AND request_id >= 0 GROUP BY request_id) u ON u.request_id = g.request_id""",
)
def grants_after_reads(t):
    """Grants with the time of the content read that used them up."""
    approved, judged = judged_reads(t)
    after = ac.used_up(approved, judged).withColumn("used_at", F.coalesce(text_of("used_at"), F.lit("")))
    return after.select("request_id", "job_id", "requester", "status", "used_at")


@query("access_audit", with_(*READ_CTES) + f"SELECT {sql_text('at')}, job_id, actor, request_id, kind, CASE WHEN kind = 'preview' AND request_id = -1 THEN ' (held-job triage)' ELSE '' END AS detail FROM outcome WHERE outcome = 'allowed'")
def access_audit(t):
    rows = ac.audit_rows(judged_reads(t)[1])
    return rows.select(text_of("at"), "job_id", "actor", F.coalesce("request_id", F.lit(-1)).alias("request_id"), "kind", "detail")


@query("access_with_grants", with_(*READ_CTES) + f"SELECT {sql_text('at')}, o.job_id, actor, kind, coalesce(g.approver, '') AS approver FROM (SELECT * FROM outcome WHERE outcome = 'allowed') o LEFT JOIN agrants g ON g.request_id = o.request_id")
def access_with_grants(t):
    approved, judged = judged_reads(t)
    return ac.access_with_grants(ac.audit_rows(judged), approved).select(text_of("at"), "job_id", "actor", "kind", F.coalesce("approver", F.lit("")).alias("approver"))


@query("preview_without_grant", with_(JOBS) + "SELECT job_id, state IN ('held', 'inspecting') AS allowed FROM jobs")
def preview_without_grant(t):
    return dv.jobs(t).select("job_id", lc.preview_without_grant(F.col("state")).alias("allowed"))


# --- console ---------------------------------------------------------------------------

JOB_ROW = f"job_id, queue, username, state, {sql_text('created_at')}"


def job_row(jobs):
    return jobs.select("job_id", "queue", "username", "state", text_of("created_at"))


@query("job_list", with_(JOBS) + f"SELECT {JOB_ROW} FROM (SELECT * FROM jobs WHERE state = 'held' AND queue = 'q3' ORDER BY created_at DESC, job_id LIMIT 100 OFFSET 20)")
def job_list(t):
    return job_row(co.list_jobs(dv.jobs(t), state="held", queue="q3", limit=100, offset=20))


@query("job_list_of_user", with_(JOBS) + f"SELECT {JOB_ROW} FROM (SELECT * FROM jobs WHERE username = 'user7' ORDER BY created_at DESC, job_id LIMIT 5000)")
def job_list_of_user(t):
    return job_row(co.list_jobs(dv.jobs(t), username="user7", limit=5000))


@query("jobs_per_state", with_(JOBS) + "SELECT state, count(*) AS jobs FROM jobs GROUP BY state")
def jobs_per_state(t):
    return co.jobs_per_state(dv.jobs(t))


@query("coverage_gaps", with_(JOBS) + "SELECT count(*) FILTER (state = 'failed_open') AS gaps FROM jobs")
def coverage_gaps(t):
    return co.coverage_gaps(dv.jobs(t))


@query("pending_grants", with_(JOBS, REQUESTS) + "SELECT count(*) FILTER (status = 'pending') AS pending FROM agrants")
def pending_grants(t):
    return co.pending_grants(granted(t)[2])


@query("held_top", with_(JOBS) + f"SELECT {JOB_ROW} FROM (SELECT * FROM jobs WHERE state = 'held' ORDER BY created_at DESC, job_id LIMIT 25)")
def held_top(t):
    return job_row(co.held_top(dv.jobs(t)))


@query("recent_top", with_(JOBS) + f"SELECT {JOB_ROW} FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 25)")
def recent_top(t):
    return job_row(co.recent_top(dv.jobs(t)))


@query("queue_view", with_(JOBS) + f"SELECT {JOB_ROW} FROM (SELECT * FROM jobs WHERE state = 'blocked' ORDER BY created_at DESC, job_id LIMIT 200)")
def queue_view(t):
    return job_row(co.queue_view(dv.jobs(t), "blocked"))


@query("held_per_queue", with_(JOBS) + "SELECT queue, count(*) AS held FROM jobs WHERE state = 'held' GROUP BY queue")
def held_per_queue(t):
    return po.held_per_queue(dv.jobs(t))


@query("policies_view", with_(QUEUES) + "SELECT queue, fail_mode FROM stored ORDER BY queue")
def policies_view(t):
    return co.policies_view(stored_queues(t)).select("queue", "fail_mode")


@query("access_log", "SELECT event_id AS access_id, user_id AS job_id, event_type AS kind FROM events ORDER BY ts DESC, event_id LIMIT 300")
def access_log(t):
    return co.access_log(
        t.events.select(F.col("event_id").alias("access_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    ).drop("at")


@query("corpus_view", "SELECT p_partkey AS document_id, p_name AS name FROM part ORDER BY p_retailprice DESC, p_partkey")
def corpus_view(t):
    listed = t.part.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("created_at"))
    return co.corpus_view(listed).drop("created_at")


@query("grant_requests_pending", with_(JOBS, REQUESTS) + "SELECT request_id, requester FROM agrants WHERE status = 'pending' ORDER BY created_at DESC, request_id")
def grant_requests_pending(t):
    return co.grant_requests(granted(t)[2]).select("request_id", "requester")


EVENT_ROWS = 'e AS (SELECT event_id, user_id AS job_id, ts AS "at", event_type AS kind, props AS detail FROM events)'


def event_rows(t):
    return t.events.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("props").alias("detail"))


@query("job_timeline", with_(EVENT_ROWS) + "SELECT job_id, event_id, kind, detail, epoch_us(\"at\") AS \"at\" FROM e ORDER BY job_id, \"at\", event_id")
def job_timeline(t):
    return co.timeline(event_rows(t)).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


@query(
    "job_detail",
    with_(JOBS, HITS, EVENT_ROWS)
    + """SELECT job_id, 'job' AS part, 0 AS seq, state AS label, verdict_reason AS detail FROM jobs UNION ALL
SELECT job_id, 'match', page, rule_id, sample FROM hits UNION ALL SELECT job_id, 'event', event_id, kind, detail FROM e""",
)
def job_detail(t):
    return co.job_detail(dv.jobs(t).withColumnRenamed("verdict_reason", "reason"), dv.hits(t), event_rows(t))


# --- scoring ---------------------------------------------------------------------------

SCORING = """
expectations AS (SELECT 'case ' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'doc-' || doc_id END || '.pdf' AS file, CASE WHEN quality = 0 OR toxic = 1 THEN 'hold' ELSE 'allow' END AS expect, doc_id % 3 = 0 AS scanned FROM labels),
titled AS (SELECT doc_id AS job_id, 'Office - doc-' || doc_id || '.docx' AS title, doc_id * 7919 % 1009 AS created_at,
  CASE doc_id % 5 WHEN 0 THEN 'held' WHEN 1 THEN 'released' WHEN 2 THEN 'released_then_flagged' WHEN 3 THEN 'released_by_analyst' ELSE 'blocked' END AS state, doc_id * 13 % 347 AS inline_ms FROM documents WHERE doc_id % 4 <> 1),
matched AS (SELECT e.*, arg_max(t.job_id, t.created_at * 1000000 + t.job_id) AS job_id FROM expectations e LEFT JOIN titled t ON contains(t.title, replace(e.file, '.pdf', '')) GROUP BY ALL),
judged AS (SELECT m.*, CASE WHEN t.state IS NULL THEN 'NOT PRINTED' WHEN (expect = 'hold') = (t.state IN ('held', 'blocked', 'released_by_analyst')) THEN 'PASS' WHEN expect = 'hold' THEN 'MISS' ELSE 'FALSE POSITIVE' END AS verdict FROM matched m LEFT JOIN titled t USING (job_id))"""


def judged_cases(t):
    k = F.col("doc_id")
    expectations = t.labels.select(
        F.concat(F.lit("case "), k.cast("string")).alias("name"),
        F.concat(F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("doc-"), k.cast("string"))), F.lit(".pdf")).alias("file"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "hold").otherwise("allow").alias("expect"), (k % 3 == 0).alias("scanned"),
    )
    jobs = t.documents.filter(k % 4 != 1).select(
        k.alias("job_id"), F.concat(F.lit("Office - doc-"), k.cast("string"), F.lit(".docx")).alias("title"), (k * 7919 % 1009).alias("created_at"),
        F.when(k % 5 == 0, "held").when(k % 5 == 1, "released").when(k % 5 == 2, "released_then_flagged").when(k % 5 == 3, "released_by_analyst").otherwise("blocked").alias("state"),
        (k * 13 % 347).alias("inline_ms"), F.lit("text").alias("scan_tier"),
    )
    return sc.judge(sc.match_jobs(expectations, jobs), jobs)


@query("scored_cases", with_(SCORING) + "SELECT name, expect, scanned, coalesce(job_id, -1) AS job_id, verdict FROM judged")
def scored_cases(t):
    """Each expectation with the newest job whose title contains its stem, and the verdict."""
    return judged_cases(t).select("name", "expect", "scanned", F.coalesce("job_id", F.lit(-1)).alias("job_id"), "verdict")


@query("score_totals", with_(SCORING) + "SELECT verdict, count(*) AS n FROM judged GROUP BY verdict")
def score_totals(t):
    return sc.totals(judged_cases(t))


@query("detection_by_tier", with_(SCORING) + "SELECT scanned, count(*) FILTER (verdict = 'PASS') AS caught, count(*) AS expected FROM judged WHERE expect = 'hold' GROUP BY scanned")
def detection_by_tier(t):
    return sc.detection_by_tier(judged_cases(t))


@query("latency_summary", with_(JOBS) + "SELECT list_sort(list(inline_ms))[count(*) // 2 + 1] AS median_ms, max(inline_ms) AS max_ms FROM jobs")
def latency_summary(t):
    return sc.latency(dv.jobs(t))


@query("manifest_cases", "SELECT 'case ' || doc_id AS name, 'doc-' || doc_id || '.pdf' AS file, CASE WHEN quality = 0 OR toxic = 1 THEN 'hold' ELSE 'allow' END AS expect, doc_id % 3 = 0 AS scanned FROM labels")
def manifest_cases(t):
    """Expectations written as a JSON manifest and read back."""
    k = F.col("doc_id")
    path = shared_dir(t.spark, "manifest")
    t.labels.select(
        F.concat(F.lit("case "), k.cast("string")).alias("name"), F.concat(F.lit("doc-"), k.cast("string"), F.lit(".pdf")).alias("file"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "hold").otherwise("allow").alias("expect"), (k % 3 == 0).alias("scanned"),
    ).write.json(path)
    return src.load_manifest(t.spark, path, lines=True)


# --- alerts and sinks ------------------------------------------------------------------

FULL_JOBS = """
full_jobs AS (SELECT j.*, 'host|' || (job_id % 5) AS hostname, CASE WHEN job_id % 3 = 0 THEN '' ELSE 'Plan=' || job_id || chr(92) || 'x' END AS title, job_id * 3 AS byte_size,
  CASE job_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'log' WHEN 2 THEN 'hold' ELSE 'block' END AS action, 'line one' || chr(10) || 'line=two ' || repeat('y', (job_id % 600)::INT) AS reason, 1 + job_id % 9 AS page_count FROM jobs j)"""

ROLLUP = """
rolled AS (SELECT job_id, sum(count)::BIGINT AS match_count, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids, max(severity) AS top_severity FROM hits GROUP BY job_id),
tops AS (SELECT job_id, sample FROM hits QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY severity DESC, score DESC, page, rule_id DESC, sample DESC) = 1)"""

KIND = "CASE WHEN state IN ('failed_open', 'released_then_flagged', 'blocked', 'held') THEN state WHEN match_count IS NOT NULL THEN 'match' ELSE 'clean' END"


def ext(key: str, value: str) -> str:
    esc = f"replace(replace(replace(replace({value}, chr(92), chr(92) || chr(92)), '=', chr(92) || '='), chr(10), ' '), chr(13), ' ')"
    return f"CASE WHEN {value} <> '' THEN '{key}=' || {esc} END"


ALERT = with_(JOBS, FULL_JOBS, HITS, ROLLUP, f"k AS (SELECT f.*, r.match_count, coalesce(r.rule_ids, '') AS rule_ids, r.top_severity, t.sample, {KIND} AS kind FROM full_jobs f LEFT JOIN rolled r USING (job_id) LEFT JOIN tops t USING (job_id))") + """
SELECT job_id, '<108>' || strftime(created_at, '%b %d %H:%M:%S') || ' scanner1 veilscan: CEF:0|Veilscan|DocumentDLP|1.0|' ||
  CASE kind WHEN 'failed_open' THEN 'INSPECTION_FAILED_OPEN|Print job released without inspection' WHEN 'released_then_flagged' THEN 'PRINT_FLAGGED_AFTER_RELEASE|Sensitive document detected after it printed'
    WHEN 'blocked' THEN 'PRINT_BLOCKED|Print job blocked by DLP policy' WHEN 'held' THEN 'PRINT_HELD|Print job held for review' WHEN 'match' THEN 'PRINT_POLICY_MATCH|Sensitive data printed' ELSE 'PRINT_CLEAN|Print job inspected, no match' END || '|' ||
  CASE kind WHEN 'failed_open' THEN 7 WHEN 'clean' THEN 1 WHEN 'released_then_flagged' THEN greatest(7, coalesce(top_severity, 5)) WHEN 'blocked' THEN greatest(8, coalesce(top_severity, 5)) WHEN 'held' THEN greatest(6, coalesce(top_severity, 5)) ELSE coalesce(top_severity, 5) END || '|' ||
  concat_ws(' ', """ + ", ".join(
    [
        ext("rt", "epoch_ms(created_at)::VARCHAR"), ext("suser", "username"), ext("shost", "hostname"), ext("dproc", "queue"), ext("fname", "title"),
        ext("fsize", "byte_size::VARCHAR"), ext("fileHash", "content_sha256"), ext("cs1", "action"), "'cs1Label=action'", ext("cs2", "job_id::VARCHAR"), "'cs2Label=jobId'",
        ext("cs3", "rule_ids"), "'cs3Label=ruleIds'", ext("cs4", "scan_tier"), "'cs4Label=scanTier'", ext("cn1", "coalesce(match_count, 0)::VARCHAR"), "'cn1Label=matchCount'",
        ext("cn2", "page_count::VARCHAR"), "'cn2Label=pageCount'", ext("cn3", "inline_ms::VARCHAR"), "'cn3Label=inspectMs'", ext("msg", "reason"), ext("cs5", "sample"),
        "CASE WHEN match_count IS NOT NULL THEN 'cs5Label=maskedSample' END",
    ]
) + ") AS line FROM k"


def alert_jobs(t):
    k = F.col("job_id")
    return dv.jobs(t).withColumns(
        {
            "hostname": F.concat(F.lit("host|"), (k % 5).cast("string")),
            "title": F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Plan="), k.cast("string"), F.lit("\\x"))),
            "byte_size": k * 3,
            "action": F.when(k % 4 == 0, "allow").when(k % 4 == 1, "log").when(k % 4 == 2, "hold").otherwise("block"),
            "reason": F.concat(F.lit("line one\nline=two "), F.repeat(F.lit("y"), (k % 600).cast("int"))),
            "page_count": k % 9 + 1, "alert_at": F.col("created_at"),
        }
    )


@query("alert_lines", ALERT)
def alert_lines(t):
    """One complete alert line per job."""
    return al.alert_lines(alert_jobs(t), dv.hits(t), "scanner1")


@query("alert_rollup", with_(HITS, ROLLUP) + "SELECT job_id, match_count, rule_ids, top_severity, sample FROM rolled JOIN tops USING (job_id)")
def alert_rollup(t):
    return al.rollup(dv.hits(t))


@query("alert_line_sink", f"SELECT md5(line) AS digest FROM ({ALERT})")
def alert_line_sink(t):
    """Alert lines written as text files and read back."""
    path = shared_dir(t.spark, "alerts")
    src.write_lines(al.alert_lines(alert_jobs(t), dv.hits(t), "scanner1"), path)
    return t.spark.read.text(path).select(F.md5("value").alias("digest"))


@query("event_sink_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1")
def event_sink_by_day(t):
    """Events written partitioned by day and counted from the sink."""
    path = shared_dir(t.spark, "events")
    src.write_by_day(t.events, path, "ts")
    return t.spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("jobs")
    )
