"""Lists and counts an operator console shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.constants import (
    AUDIT_VIEW_ROWS, DASHBOARD_ROWS, POLICY_REVISION_ROWS, QUEUE_VIEW_ROWS,
    RULE_REVISION_ROWS,
)


def _newest(jobs: DataFrame, at: str = "created_at", tie: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.desc(at), F.asc(tie))


def list_jobs(
    jobs: DataFrame, state: str | None = None, queue: str | None = None, username=None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Newest jobs first; every filter is optional and reaches the scan."""
    for name, wanted in (("state", state), ("queue", queue), ("username", username)):
        if wanted:
            jobs = jobs.filter(F.col(name) == F.lit(wanted))
    return _newest(jobs).offset(offset).limit(limit)


def jobs_per_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"))


def coverage_gaps(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("state") == "failed_open").alias("gaps"))


def pending_grants(grants: DataFrame) -> DataFrame:
    return grants.agg(F.count_if(F.col("status") == "pending").alias("pending"))


def held_top(jobs: DataFrame, rows: int = DASHBOARD_ROWS) -> DataFrame:
    return _newest(jobs.filter("state = 'held'")).limit(rows)


def recent_top(jobs: DataFrame, rows: int = DASHBOARD_ROWS) -> DataFrame:
    return _newest(jobs).limit(rows)


def queue_view(jobs: DataFrame, state: str = "held", rows: int = QUEUE_VIEW_ROWS) -> DataFrame:
    shown = jobs if state == "all" else jobs.filter(F.col("state") == F.lit(state))
    return _newest(shown).limit(rows)


def rules_view(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("enabled"), F.desc("severity"), F.asc("id"))


def policies_view(policies: DataFrame) -> DataFrame:
    return policies.orderBy("queue")


def revisions_view(revisions: DataFrame, key: str, wanted=None, rows: int | None = None) -> DataFrame:
    """Newest revisions first, of one key or of all."""
    if wanted is not None:
        revisions = revisions.filter(F.col(key) == F.lit(wanted))
    if rows is None:
        rows = POLICY_REVISION_ROWS if key == "queue" else RULE_REVISION_ROWS
    return revisions.orderBy(F.desc("at"), F.asc("revision_id")).limit(rows)


def access_log(access: DataFrame, rows: int = AUDIT_VIEW_ROWS) -> DataFrame:
    return access.orderBy(F.desc("at"), F.asc("access_id")).limit(rows)


def corpus_view(registered: DataFrame) -> DataFrame:
    return registered.orderBy(F.desc("created_at"), F.asc("document_id"))


def timeline(events: DataFrame) -> DataFrame:
    """Events of every job in time order; a range sort spreads a job with many events."""
    return events.orderBy("job_id", "at", "event_id")


def grant_requests(grants: DataFrame, job_id=None) -> DataFrame:
    """All pending requests, or every request of one job, newest first."""
    shown = grants.filter("status = 'pending'") if job_id is None else grants.filter(F.col("job_id") == F.lit(job_id))
    return shown.orderBy(F.desc("created_at"), F.asc("request_id"))


def job_detail(jobs: DataFrame, hits: DataFrame, events: DataFrame, job_id=None) -> DataFrame:
    """A job with its matches and events as labelled rows in reading order.

    Rows instead of nested lists: a job with very many events never has to fit into one row.
    """
    if job_id is not None:
        jobs, hits, events = (d.filter(F.col("job_id") == F.lit(job_id)) for d in (jobs, hits, events))
    return (
        jobs.select("job_id", F.lit("job").alias("part"), F.lit(0).cast("bigint").alias("seq"),
                    F.col("state").alias("label"), F.col("reason").alias("detail"))
        .unionByName(hits.select("job_id", F.lit("match").alias("part"), F.col("page").cast("bigint").alias("seq"),
                                 F.col("rule_id").alias("label"), F.col("sample").alias("detail")))
        .unionByName(events.select("job_id", F.lit("event").alias("part"), F.col("event_id").alias("seq"),
                                   F.col("kind").alias("label"), F.col("detail").alias("detail")))
    )
