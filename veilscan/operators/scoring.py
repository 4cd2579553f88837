"""Verdicts against labelled expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.constants import STOPPED_STATES
from veilscan.functions.core import unnest
from veilscan.operators.rank import value_at

GRAM = 8


def stem_of(file_name: Column) -> Column:
    return F.replace(file_name, F.lit(".pdf"), F.lit(""))


def runs_of_length(text: Column, n: int) -> Column:
    """All character runs of length ``n``; null for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(starts, lambda at: F.substr(text, at, F.lit(n))))


def match_jobs(expectations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Newest job whose title contains the stem of each expectation's file, if any.

    Containment is found by an equi-join: every stem is represented by one of its character
    runs, the one that the fewest titles have, every title by all of its runs of the same lengths,
    and the pairs that meet are verified. A run that every title has is thus chosen only for a stem that
    has no other. Only the newest job per stem is kept, already on the map side.
    """
    stems = expectations.select("name", stem_of(F.col("file")).alias("stem")).distinct().withColumn(
        "g", F.least(F.length("stem"), F.lit(GRAM))
    ).filter("g > 0")
    runs = stems.select("stem", "g", F.explode(F.sequence(F.lit(1), F.length("stem") - F.col("g") + 1)).alias("p")).select(
        "stem", "g", F.substr("stem", F.col("p"), F.col("g")).alias("run")
    ).distinct()
    # At most GRAM numbers.
    lengths = sorted(row.g for row in stems.select("g").distinct().collect())
    per_length = [runs_of_length(F.col("title"), n) for n in lengths]
    every_run = F.array_distinct(F.flatten(F.array_compact(F.array(*per_length)))) if lengths else F.array().cast("array<string>")
    titles = unnest(jobs, every_run, "run", ("job_id", "title", "created_at"))
    commonness = titles.select("run").join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("titles"))
    chosen = runs.join(commonness, "run", "left").groupBy("stem", "g").agg(
        F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "run")).alias("r")
    ).select("stem", F.col("r.run").alias("run"))
    newest = titles.join(chosen, "run").filter(F.contains("title", F.col("stem"))).groupBy("stem").agg(
        F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id")
    )
    named = expectations.withColumn("stem", stem_of(F.col("file")))
    # An empty stem is contained in every title.
    overall = jobs.agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id")).select(
        F.lit("").alias("stem"), "job_id"
    )
    return named.join(newest.unionByName(overall), "stem", "left").drop("stem")


def judge(matched: DataFrame, jobs: DataFrame) -> DataFrame:
    """PASS, MISS, FALSE POSITIVE or NOT PRINTED per expectation. A job flagged after its
    release was not stopped, so it counts as released."""
    joined = matched.join(jobs.select("job_id", "state", "scan_tier", "inline_ms"), "job_id", "left")
    stopped = F.col("state").isin(*STOPPED_STATES)
    return joined.withColumn(
        "verdict",
        F.when(F.col("state").isNull(), "NOT PRINTED")
        .when((F.col("expect") == "hold") & stopped, "PASS")
        .when(F.col("expect") == "hold", "MISS")
        .when(stopped, "FALSE POSITIVE")
        .otherwise("PASS"),
    )


def totals(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def detection_by_tier(judged: DataFrame) -> DataFrame:
    """Caught and expected holds, apart for text and scanned documents."""
    return judged.filter("expect = 'hold'").groupBy("scanned").agg(
        F.count_if(F.col("verdict") == "PASS").alias("caught"), F.count("*").alias("expected")
    )


def latency(jobs: DataFrame) -> DataFrame:
    """Upper median (the element at position n div 2) and maximum of ``inline_ms``; nulls where there is none."""
    times = jobs.select(F.col("inline_ms").cast("bigint").alias("ms")).filter("ms is not null")
    n, low, high = times.agg(F.count("*"), F.min("ms"), F.max("ms")).first()
    median = value_at(times, "ms", n // 2, low, high) if n else None
    return jobs.sparkSession.createDataFrame([(median, high)], "median_ms bigint, max_ms bigint")
