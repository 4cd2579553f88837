"""Queries that run as Structured Streaming jobs over the driver tables, to completion."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from veilscan.catalog import derived as dv
from veilscan.catalog import matching as mt
from veilscan.catalog import records as rc
from veilscan.catalog.derived import CORPUS, JOBS, OVERLAP_CTES, STORED_POLICIES, fingerprint_ctes, with_
from veilscan.catalog.registry import query
from veilscan.catalog.scan_sql import scan_cte
from veilscan.operators import policies as po
from veilscan.plans import inspect as pl
from veilscan.session import persist_table, shared_dir
from veilscan.sources.rules import rules_table, shipped_rules
from veilscan.streaming import feeds

DOCS_WHOLE = mt.whole("p AS (SELECT doc_id AS job_id, 1 AS page, source AS queue, text FROM documents)")
GARBLED_WHOLE = mt.whole(mt.GARBLED_PAGES)


def finished(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def stored_corpus(t):
    c = dv.corpus(t)
    return pl.Corpus(persist_table(c.registered, "registered"), persist_table(c.fingerprints, "fingerprints"))


def stored_policies(t):
    found = po.with_policy(
        dv.queue_numbers(t).select("queue"), dv.stored_policies(t), po.with_defaults(dv.file_overrides(t))
    )
    return persist_table(found, "policies")


def run_inspection(t, shape, alert_host=None):
    """Inspect the documents table as a stream; rules come from a watched rules table."""
    out, spark = shared_dir(t.spark, "inspection"), t.spark
    policies, corpus = stored_policies(t), stored_corpus(t)
    rules = rules_table(spark, shipped_rules()).withColumn("updated_at", F.lit(1))
    watch = feeds.RuleWatch(lambda: rules)
    finished(
        feeds.inspection_feed(
            feeds.table_stream(spark, t.folder, "documents.parquet"),
            lambda rows: rows.join(policies, "queue"),
            watch.current, out, f"{out}/checkpoint", corpus, alert_host, shape,
        )
    )
    return out, corpus, policies


def plain(batch):
    k = F.col("doc_id")
    return batch.select(
        k.alias("job_id"), F.lit(1).alias("page"), "text", F.col("source").alias("queue"), F.lit("u").alias("username"), F.lit("h").alias("hostname"),
        F.lit("t").alias("title"), F.octet_length("text").alias("byte_size"), F.sha2("text", 256).alias("content_sha256"), F.lit(0).alias("inline_ms"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("alert_at"),
    )


@query("stream_inspection", with_(*DOCS_WHOLE) + "SELECT * FROM verdicts")
def stream_inspection(t):
    """Continuous inspection gives the verdicts of the batch run."""
    out, _, _ = run_inspection(t, plain)
    return t.spark.read.parquet(f"{out}/verdicts").drop("batch").withColumn("score", F.round("score", 9))


LATER_RULES = mt.RULES[::2]


@query(
    "stream_rule_change",
    with_(
        "p AS (SELECT doc_id AS job_id, 1 AS page, source AS queue, text FROM documents)", STORED_POLICIES,
        "tagged AS (SELECT p.*, y.tags FROM p JOIN policies y USING (queue))", "early AS (SELECT * FROM tagged WHERE job_id % 2 = 0)",
        "late AS (SELECT * FROM tagged WHERE job_id % 2 <> 0)", scan_cte("early_hits", mt.RULES, "early", "tags"), scan_cte("late_hits", LATER_RULES, "late", "tags"),
        "hits AS (SELECT * FROM early_hits UNION ALL SELECT * FROM late_hits)", "d AS (SELECT job_id, text FROM p)", fingerprint_ctes("d", "job_id", "d"),
        CORPUS, fingerprint_ctes("corpus", "document_id", "c"), OVERLAP_CTES, mt.RULE_VERDICT, mt.CORPUS_VERDICT, mt.FACTS, mt.MERGED, mt.FINISH,
    )
    + "SELECT * FROM verdicts",
)
def stream_rule_change(t):
    """Half of the documents arrive, the rules table changes, the other half arrives: each is judged by the
    rules in force then."""
    spark, out = t.spark, shared_dir(t.spark, "rule-change")
    policies, corpus = stored_policies(t), stored_corpus(t)
    tables = [rules_table(spark, pack).withColumn("updated_at", F.lit(n)) for n, pack in enumerate((shipped_rules(), LATER_RULES))]
    now = {"rules": tables[0]}
    watch = feeds.RuleWatch(lambda: now["rules"])
    for n, table in enumerate(tables):
        now["rules"] = table
        t.documents.filter(F.col("doc_id") % 2 == n).write.mode("append").parquet(f"{out}/documents")
        finished(feeds.inspection_feed(
            feeds.table_stream(spark, f"{out}/documents", "*.parquet"), lambda rows: rows.join(policies, "queue"), watch.current,
            out, f"{out}/checkpoint", corpus, None, plain,
        ))
    return spark.read.parquet(f"{out}/verdicts").drop("batch").withColumn("score", F.round("score", 9))


@query(
    "stream_alerts",
    with_(*DOCS_WHOLE)
    + """SELECT CASE state WHEN 'held' THEN 'PRINT_HELD' WHEN 'blocked' THEN 'PRINT_BLOCKED' ELSE
  CASE WHEN job_id IN (SELECT job_id FROM hits UNION SELECT job_id FROM matches) THEN 'PRINT_POLICY_MATCH' ELSE 'PRINT_CLEAN' END END AS signature, count(*) AS n FROM verdicts GROUP BY 1""",
)
def stream_alerts(t):
    """Alert lines written by the inspection stream, counted by signature."""
    out, _, _ = run_inspection(t, plain, alert_host="scanner1")
    lines = t.spark.read.text(f"{out}/alerts")
    return lines.groupBy(F.split("value", r"\|").getItem(4).alias("signature")).agg(F.count("*").alias("n"))


@query(
    "stream_deferred",
    with_(
        f"stored_jobs AS ({with_(*GARBLED_WHOLE)} SELECT * FROM verdicts)",
        f"stored_blocked AS ({with_(*GARBLED_WHOLE)} SELECT job_id FROM hits WHERE action IN ('hold', 'block') UNION SELECT job_id FROM matches WHERE action IN ('hold', 'block'))",
        mt.GARBLED_PAGES, STORED_POLICIES, "q2 AS (SELECT p.job_id, p.page, p.original AS text, y.tags FROM p JOIN stored_jobs s USING (job_id) JOIN policies y USING (queue) WHERE scan_tier = 'ocr_pending')",
        scan_cte("hits", mt.RULES, "q2", "tags"), "d AS (SELECT job_id, text FROM q2)", fingerprint_ctes("d", "job_id", "d"), CORPUS,
        fingerprint_ctes("corpus", "document_id", "c"), OVERLAP_CTES, mt.RULE_VERDICT, mt.CORPUS_VERDICT, "j AS (SELECT job_id FROM q2)", mt.MERGED,
        "flags AS (SELECT s.*, final_rank, s.job_id IN (SELECT job_id FROM stored_blocked) AS blocked, final_rank >= 2 AS hit FROM stored_jobs s JOIN merged USING (job_id))",
    )
    + """SELECT job_id, CASE WHEN hit THEN CASE final_rank WHEN 3 THEN 'block' ELSE 'hold' END ELSE action END AS action,
  CASE WHEN hit AND state = 'released' THEN 'released_then_flagged' WHEN hit THEN CASE final_rank WHEN 3 THEN 'blocked' ELSE 'held' END
    WHEN state = 'held' AND NOT blocked THEN 'released' ELSE state END AS state FROM flags""",
)
def stream_deferred(t):
    """A second stream takes up the jobs the first has marked as pending."""
    out, corpus, policies = run_inspection(t, lambda batch: dv.garbled_of(batch))
    spark, docs = t.spark, dv.garbled(t)
    verdicts = spark.read.parquet(f"{out}/verdicts").drop("batch")
    stored = spark.read.parquet(f"{out}/evidence").drop("batch")
    def step(pending):
        ids = pending.select("job_id")
        mine = docs.join(ids, "job_id", "left_semi").join(policies, "queue")
        after, _, _ = pl.deferred(
            verdicts.join(ids, "job_id", "left_semi"), mine.select("job_id", "page", "text", "policy"),
            mine.select("job_id", "page", F.col("original").alias("text")), stored, shipped_rules(), corpus, single_page=True,
        )
        return after

    done = f"{out}/deferred"
    pending = spark.readStream.schema("job_id bigint, batch int").parquet(f"{out}/pending")
    finished(feeds.deferred_feed(pending, step, done, f"{out}/checkpoint-deferred"))
    return spark.read.parquet(done).select("job_id", "action", "state")


@query("stream_first_submissions", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_submissions(t):
    """Repeats of a key within the watermark collapse to one row."""
    out = shared_dir(t.spark, "first")
    stream = feeds.table_stream(t.spark, t.folder, "events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kept = feeds.first_submissions(stream, ["user_id", "event_type"], "ts", "365 days")
    finished(
        kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    return t.spark.read.parquet(f"{out}/rows").select("user_id", "event_type")


LIFECYCLE_KIND = "CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'log' WHEN 2 THEN 'hold' ELSE 'block' END WHEN event_type = 'view' THEN 'release' WHEN event_type = 'click' THEN 'deny' WHEN event_type = 'error' THEN 'flag' ELSE 'read' END"


@query(
    "stream_lifecycle",
    f"""SELECT user_id AS job_id, list_reduce(list({LIFECYCLE_KIND} ORDER BY ts, event_id), lambda s, k: CASE k WHEN 'allow' THEN 'released' WHEN 'log' THEN 'released' WHEN 'hold' THEN 'held' WHEN 'block' THEN 'blocked'
    WHEN 'release' THEN CASE WHEN s = 'held' THEN 'released_by_analyst' ELSE s END WHEN 'deny' THEN CASE WHEN s = 'held' THEN 'denied_by_analyst' ELSE s END
    WHEN 'flag' THEN CASE WHEN s IN ('released', 'released_by_analyst', 'failed_open', 'released_then_flagged') THEN 'released_then_flagged' ELSE 'held' END ELSE s END, 'inspecting') AS state, count(*) AS events
  FROM events GROUP BY user_id""",
)
def stream_lifecycle(t):
    """State of every job over a stream of verdicts, decisions and late findings."""
    out = shared_dir(t.spark, "lifecycle")
    e, kind = F.col("event_id"), F.col("event_type")
    stream = feeds.table_stream(t.spark, t.folder, "events.parquet").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id",
        F.when(kind == "signup", F.when(e % 4 == 0, "allow").when(e % 4 == 1, "log").when(e % 4 == 2, "hold").otherwise("block"))
        .when(kind == "view", "release").when(kind == "click", "deny").when(kind == "error", "flag").otherwise("read").alias("kind"),
    )
    writer = (
        feeds.lifecycle_states(stream).writeStream.outputMode("update").trigger(availableNow=True)
        .foreachBatch(lambda rows, n: feeds.write_batch(rows, f"{out}/states", n)).option("checkpointLocation", f"{out}/checkpoint")
    )
    finished(writer.start())
    return feeds.latest_states(t.spark.read.parquet(f"{out}/states").drop("batch"))


@query("stream_retention", with_(JOBS, rc.ARCHIVED) + f"SELECT job_id FROM archived WHERE NOT purged AND purge_after < TIMESTAMP '{rc.NOW}'")
def stream_retention(t):
    """Deadlines of arriving orders as timers, fired by a clock; each trigger reads what has arrived."""
    out, spark = shared_dir(t.spark, "retention"), t.spark
    spark.range(1).select(F.lit(rc.NOW).cast("timestamp").alias("at")).write.parquet(f"{out}/clock")
    arriving = SimpleNamespace(orders=feeds.table_stream(spark, t.folder, "orders.parquet"))
    jobs = rc.archived(arriving).select(
        "job_id", F.col("purge_after").cast("timestamp").alias("purge_after"), F.col("purged_at").isNotNull().alias("purged"))
    clock = spark.readStream.schema("at timestamp").parquet(f"{out}/clock")
    finished(
        feeds.purges_due(jobs, clock).writeStream.format("parquet").option("path", f"{out}/gone")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    return spark.read.schema("job_id bigint, purge_after timestamp").parquet(f"{out}/gone").select("job_id")
