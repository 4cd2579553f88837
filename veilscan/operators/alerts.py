"""One alert line per verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions import cef


def rollup(evidence: DataFrame) -> DataFrame:
    """Per job: total matches, distinct rule ids in order, and the top match."""
    best = F.struct(
        "severity", "score", (-F.col("page")).alias("neg_page"), F.col("rule_id").alias("by"), F.col("sample").alias("sample")
    )
    return evidence.groupBy("job_id").agg(
        F.sum("count").alias("match_count"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rule_ids"),
        F.max(best).alias("top"),
    ).select("job_id", "match_count", "rule_ids", F.col("top.severity").alias("top_severity"), F.col("top.sample").alias("sample"))


def alert_lines(jobs: DataFrame, evidence: DataFrame, host: str) -> DataFrame:
    """(job_id, line) for ``jobs`` with their verdict columns."""
    joined = jobs.join(rollup(evidence), "job_id", "left")
    kind = cef.event_kind(F.col("state"), F.col("match_count").isNotNull())
    values = {
        "rt": F.unix_millis(F.col("created_at").cast("timestamp")).cast("string"),
        "suser": F.col("username"),
        "shost": F.col("hostname"),
        "dproc": F.col("queue"),
        "fname": F.col("title"),
        "fsize": F.col("byte_size").cast("string"),
        "fileHash": F.col("content_sha256"),
        "cs1": F.col("action"),
        "cs2": F.col("job_id").cast("string"),
        "cs3": F.coalesce("rule_ids", F.lit("")),
        "cs4": F.col("scan_tier"),
        "cn1": F.coalesce("match_count", F.lit(0)).cast("string"),
        "cn2": F.col("page_count").cast("string"),
        "cn3": F.col("inline_ms").cast("string"),
        "msg": F.col("reason"),
        "cs5": F.col("sample"),
    }
    for key, label in cef.LABELS.items():
        values[key] = F.lit(label) if key != "cs5Label" else F.when(F.col("match_count").isNotNull(), F.lit(label))
    line = F.concat(
        cef.syslog_prefix(F.col("alert_at"), F.lit(host)),
        cef.header(cef.signature(kind, 0), cef.signature(kind, 1), cef.event_severity(kind, F.col("top_severity"))),
        F.lit("|"),
        cef.extensions({k: values[k] for k in cef.KEYS}),
    )
    return joined.select("job_id", line.alias("line"))
