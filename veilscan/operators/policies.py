"""Policies per queue: lookup, seeding, adoption, reconciliation and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.constants import DEFAULT_POLICY
from veilscan.functions.policy import expand_mode, policy_faults, tags_or_all
from veilscan.operators.changelog import folded, tasks_for

FIELDS = ("deep_scan_required", "fail_mode", "on_unreadable", "rule_tags")
SNAPSHOT = ("queue", *FIELDS, "description", "enabled", "shared")


def default_value(name: str):
    value = DEFAULT_POLICY[name]
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def with_defaults(overrides: DataFrame) -> DataFrame:
    """File policies: the default block overlaid by what each queue sets itself."""
    return overrides.select(
        "queue", *[F.coalesce(F.col(f), default_value(f)).alias(f) for f in FIELDS]
    )


def with_policy(jobs: DataFrame, stored: DataFrame, from_file: DataFrame) -> DataFrame:
    """Effective policy of each job's queue: stored row, else file row, else default."""
    first = stored.select("queue", F.struct(*FIELDS[:3], tags_or_all(F.col("rule_tags")).alias("rule_tags")).alias("p1"))
    second = from_file.select("queue", F.struct(*FIELDS).alias("p2"))
    fallback = F.struct(*[default_value(f).alias(f) for f in FIELDS])
    return (
        jobs.join(first, "queue", "left")
        .join(second, "queue", "left")
        .withColumn("policy", F.coalesce("p1", "p2", fallback))
        .drop("p1", "p2")
    )


def seed(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet; stored rows are never overwritten."""
    return incoming.join(stored.select(key), key, "left_anti")


def adopt(live: DataFrame, stored: DataFrame, scheme: str) -> DataFrame:
    """Live queues unknown here that are inspected ones: their device has ``scheme`` and they
    are not the internal half of a pair."""
    prefix = f"{scheme}://"
    rest = F.substr(F.col("uri"), F.lit(len(prefix) + 1))
    return (
        live.filter(F.startswith("uri", F.lit(prefix)) & ~F.endswith("queue", F.lit("-device")))
        .join(stored.select("queue"), "queue", "left_anti")
        .select(
            "queue",
            F.concat(F.substring_index(rest, "/", 1), F.lit("://"),
                     F.when(F.contains(rest, F.lit("/")), F.substr(rest, F.instr(rest, "/") + 1)).otherwise(F.lit(""))).alias("device_uri"),
        )
    )


def reconcile(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Every queue name known to either side with its status."""
    return (
        stored.select("queue", F.lit(True).alias("here"))
        .join(live.select("queue", F.lit(True).alias("there")), "queue", "full_outer")
        .select(
            "queue",
            F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "unmanaged")
            .otherwise("managed").alias("status"),
        )
    )


def missing_names(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.select("queue").subtract(live.select("queue"))


def held_per_queue(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("state") == "held").groupBy("queue").agg(F.count("*").alias("held"))


def apply_changes(
    stored: DataFrame, changes: DataFrame, jobs: DataFrame, order: tuple[str, ...] = ("at",)
) -> tuple[DataFrame, DataFrame]:
    """Policy changes in the order of time, any number per queue, applied to the stored table.

    ``changes(queue, change, actor, at, mode, deep_scan_required, fail_mode, on_unreadable,
    rule_tags)``: create needs an unknown queue, update and delete a known one, and a queue
    with held jobs is not deleted. A mode is expanded before it meets the old row, so it wins
    over old values, while explicit fields win over the mode. Returns the new table and an
    outcome row per change, which doubles as its revision when the outcome is ``applied``.
    """
    change = F.col("change")
    tasks = tasks_for(changes)
    held = held_per_queue(jobs).repartition(tasks, "queue")
    judged = changes.repartition(tasks, "queue").join(held, "queue", "left").withColumns({
        "held": F.coalesce("held", F.lit(0)),
        "faults": F.array_join(policy_faults(F.col("mode"), F.col("fail_mode"), F.col("on_unreadable")), ","),
    })
    good = F.col("faults") == ""
    writes = change != "delete"

    def outcome(exists):
        return (
            F.when((change == "create") & exists, "exists")
            .when((change != "create") & ~exists, "unknown queue")
            .when((change == "delete") & (F.col("held") > 0), "jobs held")
            .when(writes & ~good, F.concat(F.lit("bad "), F.col("faults")))
            .otherwise("applied")
        )

    asked = {
        "deep_scan_required": expand_mode(F.col("mode"), "deep_scan_required", F.col("deep_scan_required")),
        "fail_mode": F.col("fail_mode"),
        "on_unreadable": expand_mode(F.col("mode"), "on_unreadable", F.col("on_unreadable")),
        "rule_tags": F.when(F.size("rule_tags") > 0, F.col("rule_tags")),
    }
    after, log = folded(
        stored, judged, "queue", FIELDS, (change == "create") & good, (change == "delete") & (F.col("held") == 0), outcome,
        {f: F.when(writes, value) for f, value in asked.items()}, {f: default_value(f) for f in FIELDS}, order, tasks,
    )
    return after, log.select("queue", *[c for c in order if c != "at"], "at", "actor", "change", "outcome", *FIELDS)


def latest(revisions: DataFrame, key: str, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Newest revision per key; a key whose newest change is a deletion is gone. A grouped
    maximum keeps one row per key and map task, so a key with many revisions costs nothing."""
    rest = [c for c in revisions.columns if c != key]
    newest = revisions.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    )
    return newest.select(key, "r.*").filter(~F.col("change").isin("delete", "deleted"))


def version(table: DataFrame, updated: str = "updated_at") -> DataFrame:
    """Cheap probe that tells whether a table has changed: row count and newest update."""
    return table.agg(F.count("*").alias("n"), F.max(updated).alias("latest"))
