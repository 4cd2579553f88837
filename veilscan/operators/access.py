"""Grants to read archived content, their use, and the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.lifecycle import grant_expiry, preview_without_grant
from veilscan.session import persist_table, ship_by_value

ship_by_value(__name__)

# Kinds of reads; only a content read uses a grant up.
READ_KINDS = ("content", "text", "preview")


def is_valid(now: Column) -> Column:
    return (
        (F.col("status") == "approved") & F.col("used_at").isNull()
        & F.col("expires_at").isNotNull() & (F.col("expires_at") > now)
    )


def valid_grants(grants: DataFrame, now: Column) -> DataFrame:
    return grants.filter(is_valid(now))


def request(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """New grants from ``requests(request_id, job_id, requester, reason, at)`` with their
    outcome: a job whose body is purged cannot be asked for."""
    return requests.join(jobs.select("job_id", "purged_at"), "job_id", "left_outer").select(
        "request_id", "job_id", "requester", "reason", F.col("at").alias("created_at"),
        F.when(F.col("purged_at").isNotNull(), "purged").otherwise("pending").alias("status"),
        F.when(F.col("purged_at").isNull(), grant_expiry(F.col("at"))).alias("expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("used_at"),
    )


def approve(grants: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``approvals(request_id, approver, at)``: (grants after, outcomes). Only a pending
    request can be approved, by someone else; the first such approval counts and restarts
    the expiry."""
    judged = approvals.join(grants.select("request_id", "status", "requester"), "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("status").isNull(), "not found")
        .when(F.col("status") != "pending", F.concat(F.lit("already "), "status"))
        .when(F.col("approver") == F.col("requester"), "own request")
        .otherwise("approved"),
    )
    first = judged.filter("outcome = 'approved'").groupBy("request_id").agg(
        F.min(F.struct(F.col("at").alias("decided_at"), F.col("approver").alias("decider"))).alias("d")
    )
    after = grants.join(first, "request_id", "left").select(
        "request_id", "job_id", "requester", "reason", "created_at",
        F.when(F.col("d").isNotNull(), "approved").otherwise(F.col("status")).alias("status"),
        F.col("d.decider").alias("approver"), F.col("d.decided_at").alias("decided_at"),
        F.coalesce(grant_expiry(F.col("d.decided_at")), F.col("expires_at")).alias("expires_at"),
        "used_at",
    )
    outcomes = judged.join(first, "request_id", "left").select(
        "request_id", "approver", "at",
        F.when(
            (F.col("outcome") == "approved")
            & ((F.col("at") != F.col("d.decided_at")) | (F.col("approver") != F.col("d.decider"))),
            "already approved",
        ).otherwise(F.col("outcome")).alias("outcome"),
    )
    return after, outcomes


def read(jobs: DataFrame, grants: DataFrame, reads: DataFrame) -> DataFrame:
    """Judge ``reads(read_id, job_id, actor, kind, at)`` against approved grants.

    A read needs a grant of the same job and person that is approved, not expired and not
    used up; a preview of a job in review needs none. A content read uses up the valid grant
    that expires first, text and preview reads use up nothing.
    """
    state = jobs.select("job_id", "state", F.col("purged_at").isNotNull().alias("purged"))
    judged = reads.join(state, "job_id").withColumns(
        {
            "free": (F.col("kind") == "preview") & preview_without_grant(F.col("state")),
            "gone": F.col("purged") & (F.col("kind") != "text"),
        }
    )
    usable = grants.filter("status = 'approved' and used_at is null").select(
        "job_id", F.col("requester").alias("actor"), "request_id", "expires_at", "decided_at"
    )
    per_person = usable.groupBy("job_id", "actor").agg(F.count("*").alias("held"))
    # Read for both kinds of persons, and its grants may be the end of long work.
    usable = persist_table(usable.join(per_person, ["job_id", "actor"]), "usable-grants")
    asking = judged.filter("not free and not gone").select("read_id", "job_id", "actor", "kind", "at")
    covered = _covered_by_one(asking, usable.filter("held = 1").drop("held"))
    several = usable.filter("held > 1").drop("held")
    if not several.isEmpty():
        covered = covered.unionByName(_covered_by_several(asking, several))
    return judged.join(covered, "read_id", "left").select(
        "read_id", "job_id", "actor", "kind", "at",
        F.when(F.col("gone"), "purged")
        .when(F.col("free") | F.col("request_id").isNotNull(), "allowed")
        .otherwise("approval required").alias("outcome"),
        "request_id",
    )


def _in_time() -> Column:
    return (F.col("at") >= F.col("decided_at")) & (F.col("at") < F.col("expires_at"))


def _covered_by_one(asking: DataFrame, grants: DataFrame) -> DataFrame:
    """Reads covered where a person holds one grant for a job: all up to the first content
    read, which uses it up."""
    within = asking.join(grants, ["job_id", "actor"]).filter(_in_time())
    used = within.filter("kind = 'content'").groupBy("request_id").agg(
        F.min(F.struct("at", "read_id")).alias("used")
    )
    return within.join(used, "request_id", "left").filter(
        F.col("used").isNull() | (F.struct("at", "read_id") <= F.col("used"))
    ).select("read_id", "request_id")


def _covered_by_several(asking: DataFrame, grants: DataFrame) -> DataFrame:
    """The same where a person holds several grants for one job. Which one a read meets then
    depends on all earlier reads, so these few groups are walked in time order."""

    def walk(keys, left, right):
        import pandas as pd

        free = sorted(zip(right["expires_at"], right["decided_at"], right["request_id"]))
        out = []
        for row in left.sort_values(["at", "read_id"]).itertuples():
            valid = [g for g in free if g[1] <= row.at < g[0]]
            if valid:
                out.append((row.read_id, valid[0][2]))
                if row.kind == "content":
                    free.remove(valid[0])
        return pd.DataFrame(out, columns=["read_id", "request_id"])

    types = {f.name: f.dataType.simpleString() for f in [*asking.schema, *grants.schema]}
    schema = f"read_id {types['read_id']}, request_id {types['request_id']}"
    # Only reads inside a grant's time can be covered; the others never enter a group.
    within = asking.join(grants, ["job_id", "actor"]).filter(_in_time()).select(asking.columns).distinct()
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (within, grants))
    return left.groupBy("job_id", "actor").cogroup(right.groupBy("job_id", "actor")).applyInPandas(walk, schema)


def used_up(grants: DataFrame, judged_reads: DataFrame) -> DataFrame:
    """The grants table after ``judged_reads``: ``used_at`` is set where a content read used a
    grant, so that later reads find it used. A grant is used once; an earlier use stays."""
    used = judged_reads.filter("kind = 'content' and outcome = 'allowed' and request_id is not null").groupBy(
        "request_id").agg(F.min("at").alias("now_used"))
    return grants.join(used, "request_id", "left").withColumn("used_at", F.coalesce("used_at", "now_used")).drop("now_used")


def audit_rows(judged_reads: DataFrame) -> DataFrame:
    """Access-log rows: one per read that was let through."""
    return judged_reads.filter("outcome = 'allowed'").select(
        "at", "job_id", "actor", "request_id", "kind",
        F.when((F.col("kind") == "preview") & F.col("request_id").isNull(), " (held-job triage)")
        .otherwise("").alias("detail"),
    )


def access_with_grants(access: DataFrame, grants: DataFrame) -> DataFrame:
    """Access rows with the grant they used, if any."""
    return access.join(
        grants.select("request_id", "approver", "status"), "request_id", "left"
    )
