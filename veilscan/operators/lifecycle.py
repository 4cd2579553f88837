"""State of jobs: repeats, failures, unreadable bodies, decisions, retention, deferred tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilscan.constants import (
    GRANT_TTL_HOURS, MAX_BODY_BYTES, PREVIEW_STATES, PRINTED_STATES,
    REASON_MAX_CHARS, REASON_MIN_CHARS, RETENTION_DAYS,
)
from veilscan.functions.core import action_rank, state_of_action

HOLD = 2


def originating_host(options: Column) -> Column:
    """Workstation name inside a job's options text, unquoted; empty when absent."""
    found = F.regexp_extract(options, r"(?:^|\s)job-originating-host-name=(\S*)", 1)
    return F.coalesce(F.btrim(found, F.lit("'\"")), F.lit(""))


def purge_deadline(stored_at: Column, days: int = RETENTION_DAYS) -> Column:
    return stored_at + F.make_dt_interval(F.lit(days))


def archive_key(stored_at: Column, job_id: Column) -> Column:
    return F.concat(F.date_format(stored_at, "yyyy/MM/dd"), F.lit("/"), job_id.cast("string"), F.lit(".bin"))


def grant_expiry(at: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(GRANT_TTL_HOURS))


def intake(documents: DataFrame) -> DataFrame:
    """Submitted documents as new jobs: host from options, size and digest."""
    return documents.withColumns(
        {
            "hostname": originating_host(F.col("options")),
            "byte_size": F.octet_length("body").cast("bigint"),
            "content_sha256": F.sha2(F.col("body"), 256),
            "state": F.lit("inspecting"),
            "archive_key": archive_key(F.col("created_at"), F.col("job_id")),
            "purge_after": purge_deadline(F.col("created_at")),
        }
    )


def oversize(byte_size: Column, fail_mode: Column, limit: int = MAX_BODY_BYTES) -> Column:
    """Outcome for a body over the inline limit, null for one within it."""
    return F.when(
        byte_size > limit,
        F.when(fail_mode == "closed", F.lit("hold")).otherwise(F.lit("release uninspected")),
    )


def newest_per(jobs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as a grouped maximum: each map task sends one row per key, so a
    key that holds a third of all rows is reduced before the shuffle."""
    rest = [c for c in jobs.columns if c not in keys]
    return jobs.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    ).select(*keys, "row.*")


# Fixed value: what the event of a repeated submission says.
REINSPECTED = "CUPS re-ran the backend for this job"

SAME_DOCUMENT = ["queue", "cups_job_id", "content_sha256"]


def reinspect(jobs: DataFrame, hits: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions against stored jobs: (routed, hits kept, events).

    A submission whose key has an unpurged job reuses the newest of them: its stored hits are
    dropped and a ``reinspected`` event is written. Others become new jobs.
    """
    reusable = newest_per(
        jobs.filter("purged_at is null").select(*SAME_DOCUMENT, F.col("job_id").alias("reused_id"), "created_at"),
        SAME_DOCUMENT, ["created_at", "reused_id"],
    ).drop("created_at")
    routed = submissions.join(reusable, SAME_DOCUMENT, "left")
    reused = routed.filter("reused_id is not null")
    kept = hits.join(reused.select(F.col("reused_id").alias("job_id")).distinct(), "job_id", "left_anti")
    events = reused.select(F.col("reused_id").alias("job_id"), "at", F.lit("reinspected").alias("kind"))
    return routed, kept, events


@dataclass
class Merged:
    """Tables after a batch of submissions: all jobs, pages and hits still stored, events written."""

    jobs: DataFrame
    pages: DataFrame
    hits: DataFrame
    events: DataFrame
    targets: DataFrame  # submission, job_id it is inspected under, whether that job was there before


def merge_submissions(jobs: DataFrame, pages: DataFrame, hits: DataFrame, submissions: DataFrame) -> Merged:
    """A batch of ``submissions(submission, job_id, at, queue, cups_job_id, content_sha256, ...)`` merged into
    the stored tables; ``job_id`` is the id a submission gets if it becomes a job of its own.

    Submissions of one document go to one job: the newest unpurged stored one, else the job of the first
    of them in the batch. Such a job is under inspection again, its pages and hits are gone, and every
    submission that did not make its job leaves a ``reinspected`` event. A document without a full key is
    like no other. Only keys and ids are shuffled; text is left where it is but for the join that drops it.
    """
    stored = newest_per(
        jobs.filter("purged_at is null").select(*SAME_DOCUMENT, F.col("job_id").alias("stored_id"), "created_at"),
        SAME_DOCUMENT, ["created_at", "stored_id"],
    ).drop("created_at")
    first = submissions.groupBy(*SAME_DOCUMENT).agg(
        F.min_by(F.struct("submission", "job_id"), F.struct("at", "submission")).alias("first"))
    routed = submissions.join(stored, SAME_DOCUMENT, "left").join(first, SAME_DOCUMENT, "left").withColumn(
        "target", F.coalesce("stored_id", "first.job_id", "job_id"))
    makes = F.col("stored_id").isNull() & (F.coalesce("first.submission", "submission") == F.col("submission"))
    routed = routed.withColumn("makes", makes)
    again = routed.filter("not makes").select(F.col("target").alias("job_id"))
    known = again.distinct()
    kept = [c for c in jobs.columns if c in submissions.columns and c != "state"]
    empty = [c for c in jobs.columns if c not in kept and c != "state"]
    new = routed.filter("makes").select(
        *kept, F.lit("inspecting").alias("state"), *[F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in empty]
    )
    after = jobs.join(known.withColumn("again", F.lit(True)), "job_id", "left").withColumn(
        "state", F.when(F.col("again"), "inspecting").otherwise(F.col("state"))
    ).select(jobs.columns).unionByName(new)
    events = routed.filter("not makes").select(
        F.col("target").alias("job_id"), "submission", "at", F.lit("reinspected").alias("kind"), F.lit(REINSPECTED).alias("detail"))
    return Merged(
        after, pages.join(known, "job_id", "left_anti"), hits.join(known, "job_id", "left_anti"), events,
        routed.select("submission", F.col("target").alias("job_id"), (~F.col("makes")).alias("known")),
    )


def preflight(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether an analyst already released this very job, with the newest such reason."""
    cleared = newest_per(
        jobs.filter("state = 'released_by_analyst'").select("queue", "cups_job_id", "job_id", "created_at", "verdict_reason"),
        ["queue", "cups_job_id"], ["created_at", "job_id"],
    )
    return requests.join(cleared, ["queue", "cups_job_id"], "left").select(
        "queue", "cups_job_id",
        F.col("job_id").isNotNull().alias("pass_through"),
        "job_id",
        F.when(F.col("job_id").isNotNull(), F.concat(F.lit("released by analyst: "), "verdict_reason"))
        .otherwise(F.lit("")).alias("reason"),
    )


def resolve_failure(jobs: DataFrame) -> DataFrame:
    """Outcome of a failed inspection from ``failure``, ``policy`` and partial hits
    (``rank``, ``matched_reason``): the fail mode decides unless a partial hit is stricter."""
    closed = F.col("policy.fail_mode") == "closed"
    fallback = F.when(closed, F.lit("hold")).otherwise(F.lit("log"))
    stricter = F.coalesce(F.col("rank"), F.lit(0)) > action_rank(fallback)
    action = F.when(stricter, F.when(F.col("rank") == 3, "block").otherwise("hold")).otherwise(fallback)
    return jobs.select(
        "job_id",
        action.alias("action"),
        F.when(stricter, state_of_action(action)).when(closed, "held").otherwise("failed_open").alias("state"),
        F.when(stricter, F.concat("matched_reason", F.lit(" (partial scan: "), "failure", F.lit(")")))
        .otherwise(F.col("failure")).alias("reason"),
        F.concat(F.lit("fail_"), "policy.fail_mode").alias("event"),
    )


def resolve_unreadable(jobs: DataFrame) -> DataFrame:
    """Outcome for bodies that cannot be read: the queue's ``on_unreadable`` action."""
    kind = F.when(F.col("encrypted"), F.lit("encrypted")).otherwise(
        F.concat(F.lit("unreadable ("), "format", F.lit(")"))
    )
    action = F.col("policy.on_unreadable")
    return jobs.select(
        "job_id", action.alias("action"), state_of_action(action).alias("state"),
        F.lit("unreadable").alias("scan_tier"),
        F.concat(F.lit("document is "), kind, F.lit("; queue policy says "), action).alias("reason"),
    )


def deep_scan_hold(thin_pages: Column, required: Column, rank: Column) -> Column:
    """Whether pages that could not be read make this job wait for the deferred tier."""
    return (thin_pages > 0) & required & (rank < HOLD)


def deep_scan_reason(thin_pages: Column) -> Column:
    return F.concat(
        thin_pages.cast("string"),
        F.lit(" page(s) could not be read as text and this queue requires a deep scan before release"),
    )


def ocr_batch(thin: DataFrame, limit: int | None = None) -> DataFrame:
    """Thin pages to recognise: all of them, or the first ``limit`` of each job (Spark then keeps
    only the leading rows of each group before the shuffle)."""
    if limit is None:
        return thin
    ranked = W.partitionBy("job_id").orderBy("page")
    return thin.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= limit).drop("rn")


def recognised_pages(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with their recognised text where there is one."""
    return pages.join(
        recognised.select("job_id", "page", F.col("text").alias("ocr_text")), ["job_id", "page"], "left"
    ).select("job_id", "page", F.coalesce("ocr_text", "text").alias("text"))


def blocked_before(stored_evidence: DataFrame) -> DataFrame:
    """Jobs that a match of the first tier holds or blocks."""
    return stored_evidence.filter((F.col("tier") != "ocr") & (action_rank(F.col("action")) >= HOLD)).select("job_id").distinct()


def resolve_deferred(jobs: DataFrame) -> DataFrame:
    """Outcome of the deferred tier for ``jobs(job_id, state, action, score, reason, thin,
    blocked, ocr_rank, ocr_reason, ocr_score)``.

    Nothing thin: only the tier changes. A hit on a printed job is an incident, on any other
    job it decides the state, even after a decision. A clean result frees a job that was held
    for the scan alone.
    """
    looked = F.col("thin") > 0
    hit = looked & (F.col("ocr_rank") >= HOLD)
    printed = F.col("state").isin(*PRINTED_STATES)
    freed = looked & ~hit & (F.col("state") == "held") & ~F.col("blocked")
    hit_action = F.when(F.col("ocr_rank") == 3, "block").otherwise("hold")
    return jobs.select(
        "job_id",
        F.when(hit, hit_action).otherwise(F.col("action")).alias("action"),
        F.when(hit & printed, "released_then_flagged")
        .when(hit, state_of_action(hit_action))
        .when(freed, "released")
        .otherwise(F.col("state")).alias("state"),
        F.when(looked, F.greatest("score", "ocr_score")).otherwise(F.col("score")).alias("score"),
        F.when(
            hit & printed,
            F.concat(
                F.lit("OCR found "), "ocr_reason",
                F.lit(" AFTER the job printed — this queue releases while the deep scan runs (deep_scan_required is off)"),
            ),
        )
        .when(hit, F.concat(F.lit("OCR: "), "ocr_reason"))
        .when(freed, "deep scan clear")
        .otherwise(F.col("reason")).alias("reason"),
        F.lit("ocr_complete").alias("scan_tier"),
        F.when(~looked, F.lit(None))
        .when(hit & printed, "deep_scan_hit_after_release")
        .when(hit, "deep_scan_hit")
        .otherwise("deep_scan_clear").alias("event"),
    )


def decide(jobs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyst decisions against held jobs: (jobs after, outcome per decision).

    ``decisions(decision_id, job_id, at, actor, verb, reason)``. Only a held job can be
    decided, once, by the first valid decision; the reason has a minimum and maximum length.
    """
    length = F.length(F.coalesce("reason", F.lit("")))
    judged = decisions.join(jobs.select("job_id", "state"), "job_id", "left").withColumn(
        "fault",
        F.when(~length.between(REASON_MIN_CHARS, REASON_MAX_CHARS), "bad reason")
        .when(F.col("state").isNull(), "unknown job")
        .when(F.col("state") != "held", F.concat(F.lit("job is "), "state", F.lit(", not held"))),
    )
    first = judged.filter("fault is null").groupBy("job_id").agg(
        F.min_by(F.struct("decision_id", "verb", "reason"), F.struct("at", "decision_id")).alias("d")
    )
    outcomes = judged.join(
        first.select("job_id", F.col("d.decision_id").alias("won")), "job_id", "left"
    ).select(
        "decision_id", "job_id", "verb", "actor", "at",
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("won") == F.col("decision_id"), "applied")
        .otherwise("already decided").alias("outcome"),
    )
    after = jobs.join(first, "job_id", "left").withColumns(
        {
            "state": F.when(F.col("d.verb") == "release", "released_by_analyst")
            .when(F.col("d.verb") == "deny", "denied_by_analyst").otherwise(F.col("state")),
            "verdict_reason": F.coalesce(F.col("d.reason"), F.col("verdict_reason")),
        }
    ).drop("d")
    return after, outcomes


def purge(jobs: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Expire archived bodies: (jobs after, ids purged). Metadata stays, the key is
    blanked. With ``limit`` only that many go, oldest deadlines first."""
    due = jobs.filter(F.col("purged_at").isNull() & (F.col("purge_after") < now)).select("job_id", "purge_after")
    if limit is not None:
        due = due.orderBy("purge_after", "job_id").limit(limit)
    gone = due.select("job_id")
    after = jobs.join(gone.withColumn("gone", F.lit(True)), "job_id", "left").withColumns(
        {
            "archive_key": F.when(F.col("gone"), F.lit("")).otherwise(F.col("archive_key")),
            "purged_at": F.when(F.col("gone"), now).otherwise(F.col("purged_at")),
        }
    ).drop("gone")
    return after, gone


def drop_text(pages: DataFrame, gone: DataFrame) -> DataFrame:
    return pages.join(gone, "job_id", "left_anti")


def preview_without_grant(state: Column, allowed: Column | None = None) -> Column:
    inside = state.isin(*PREVIEW_STATES)
    return inside if allowed is None else inside & allowed


