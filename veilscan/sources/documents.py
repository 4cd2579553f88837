"""Document, page and manifest sources; evidence and alert sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.constants import DEFAULT_POLICY
from veilscan.sources.rules import _parse


def paged(documents: DataFrame, page_break: str = "\f") -> DataFrame:
    """(job_id, page, text) with pages numbered from 1, from a text with page breaks."""
    return documents.select(
        "job_id", F.posexplode(F.split("text", page_break)).alias("at", "text")
    ).select("job_id", (F.col("at") + 1).alias("page"), "text")


def load_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policy file (YAML or JSON): a default block overlaid by each queue's own fields."""
    from pathlib import Path

    content = _parse(Path(path)) or {}
    base = DEFAULT_POLICY | (content.get("default") or {})
    rows = [
        (name, *[(base | (own or {}))[f] for f in ("deep_scan_required", "fail_mode", "on_unreadable", "rule_tags")])
        for name, own in (content.get("queues") or {}).items()
    ]
    return spark.createDataFrame(
        rows, "queue string, deep_scan_required boolean, fail_mode string, on_unreadable string, rule_tags array<string>"
    )


def load_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Expectation manifest: one JSON list of cases, or one case per line, which also splits."""
    shape = "name string, file string, expect string, scanned boolean"
    return spark.read.schema(shape).option("multiLine", not lines).json(path)


def write_by_day(df: DataFrame, path: str, at: str) -> None:
    """Append rows partitioned by day, one file set per day and task."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)
