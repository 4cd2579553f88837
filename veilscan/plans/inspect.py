"""Document in, verdict out: the batch pipeline, one pass over the text and one lazy graph behind it.

documents -> pages -> rule hits and fingerprint matches -> merged with the queue's policy
-> verdict, evidence rows, events, alert lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.core import two_decimals, unnest
from veilscan.functions.text import fingerprint, is_thin
from veilscan.operators import evidence as ev
from veilscan.operators import lifecycle as lc
from veilscan.operators.fingerprint import corpus_matches, joined_parts, matches_of_prints, parts_of
from veilscan.operators.scan import hit_rows, page_hits, scan_pages
from veilscan.session import persist_table
from veilscan.sources.rules import Rule


@dataclass
class Corpus:
    registered: DataFrame
    fingerprints: DataFrame


@dataclass
class Inspection:
    hits: DataFrame
    matches: DataFrame
    evidence: DataFrame
    verdicts: DataFrame
    events: DataFrame


def page_facts(pages: DataFrame) -> DataFrame:
    """Per job: pages, characters and thin pages, counted where the pages are read."""
    carried = [c for c in pages.columns if c in ("job_id", "policy")]
    return job_facts(pages.select(*carried, F.length("text").alias("chars"), is_thin(F.col("text")).alias("thin")))


def job_facts(read: DataFrame) -> DataFrame:
    """The same from pages whose characters are counted and judged."""
    carried = [F.any_value("policy").alias("policy")] if "policy" in read.columns else []
    return read.groupBy("job_id").agg(
        F.count("*").alias("page_count"),
        F.sum("chars").alias("chars"),
        F.count_if("thin").alias("pages_without_text"),
        *carried,
    )


def no_matches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "job_id bigint, document_id bigint, document_name string, severity int, action string, overlap bigint, ratio double"
    )


def inspect(
    pages: DataFrame, rules: Sequence[Rule], corpus: Corpus | None = None, single_page: bool = False
) -> Inspection:
    """Verdicts for ``pages(job_id, page, text, policy)``.

    ``policy`` comes from a lookup by queue, so pages are not shuffled to get it. One pass over the text
    yields everything that is asked of it: hits, characters, whether a page is thin, and fingerprints
    (of pages: the parts they are joined from). That is written, and all results come from there.
    ``single_page`` says that every job is one page: its facts, hits and rule decision then stay in its
    row, and no hit is shuffled.
    """
    tagged = pages.withColumn("tags", F.col("policy.rule_tags"))
    prints = [] if corpus is None else [
        (fingerprint(F.col("text")) if single_page else parts_of(F.col("text"))).alias("prints")]
    read = persist_table(tagged.select(
        "job_id", "page", "policy", page_hits(tagged, rules, tags="tags").alias("found"),
        F.length("text").cast("bigint").alias("chars"), is_thin(F.col("text")).alias("thin"), *prints,
    ), "inspected-pages")
    hits = hit_rows(read, F.col("found"))
    if corpus is None:
        matches = no_matches(pages.sparkSession)
    else:
        rows = (unnest(read, F.col("prints"), "h", ("job_id",)) if single_page
                else joined_parts(read.select("job_id", "page", "prints.*")))
        matches = matches_of_prints(rows, corpus.registered, corpus.fingerprints)
    if single_page:
        rows = read.select(
            "job_id", F.struct("policy.deep_scan_required").alias("policy"), F.lit(1).cast("bigint").alias("page_count"),
            "chars", F.col("thin").cast("bigint").alias("pages_without_text"),
            F.transform("found", lambda h: h.withField("page", F.lit(1))).alias("found"),
        )
        judged = ev.decide_in_row(rows, "found", ("job_id", "policy", "page_count", "chars", "pages_without_text"))
    else:
        judged = job_facts(read).join(ev.decide_rules(hits), "job_id", "left")
    verdicts, events = finish(ev.merged(judged, ev.decide_corpus(matches)))
    return Inspection(hits, matches, ev.evidence(hits, matches), verdicts, events)


def finish(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the deep-scan policy and shape verdicts and their ``inspected`` events."""
    waits = lc.deep_scan_hold(
        F.col("pages_without_text"), F.col("policy.deep_scan_required"), F.col("final_rank")
    )
    held = judged.withColumns(
        {
            "final_reason": F.when(waits, lc.deep_scan_reason(F.col("pages_without_text"))).otherwise(F.col("final_reason")),
            "final_rank": F.when(waits, F.lit(lc.HOLD)).otherwise(F.col("final_rank")),
        }
    )
    verdicts = held.withColumns(ev.verdict_columns()).select(
        "job_id", "action", "state", F.col("final_reason").alias("reason"), F.col("final_score").alias("score"),
        F.when(F.col("pages_without_text") > 0, "ocr_pending").otherwise("text").alias("scan_tier"),
        "page_count", "chars", "pages_without_text", "rule_hits",
    )
    events = verdicts.select(
        "job_id", F.lit("inspected").alias("kind"), F.lit("system").alias("actor"),
        F.concat(
            F.lit("action="), "action", F.lit(" score="), two_decimals(F.col("score")),
            F.lit(" rules="), F.col("rule_hits").cast("string"),
        ).alias("detail"),
    )
    return verdicts, events


def deferred(
    jobs: DataFrame, pages: DataFrame, recognised: DataFrame, stored_evidence: DataFrame,
    rules: Sequence[Rule], corpus: Corpus | None = None, single_page: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Second tier: (jobs after, evidence added, pages after).

    ``pages`` carry their policy; ``recognised(job_id, page, text)`` replaces thin pages' text. Rules run on the
    recognised pages, fingerprints on the whole new text. Corpus matches of this tier move
    the verdict but are not stored as evidence.
    """
    thin_pages = pages.filter(is_thin(F.col("text"))).select("job_id", "page", F.col("policy.rule_tags").alias("tags"))
    usable = recognised.join(lc.ocr_batch(thin_pages), ["job_id", "page"])
    after = lc.recognised_pages(pages.select("job_id", "page", "text"), usable)
    hits = scan_pages(usable, rules, tags="tags", tier="ocr")
    looked = thin_pages.groupBy("job_id").agg(F.count("*").alias("thin"))
    if corpus is None:
        best = None
    else:
        # Only jobs with a thin page are looked at again: their pages are chosen before anything is joined.
        mine = pages.select("job_id", "page", "text").join(looked.select("job_id"), "job_id", "left_semi")
        again = lc.recognised_pages(mine, usable)
        texts = again.select("job_id", "text") if single_page else again
        best = ev.decide_corpus(corpus_matches(texts, corpus.registered, corpus.fingerprints))
    known = jobs.select("job_id", "state", "action", "score", "reason").join(looked, "job_id", "left")
    blocked = lc.blocked_before(stored_evidence).withColumn("blocked", F.lit(True))
    if best is None:
        best = known.select(
            "job_id", F.lit(0).alias("match_rank"), F.lit("").alias("match_name"), F.lit(0.0).alias("match_ratio")
        )
    found = ev.merged(known.select("job_id").join(ev.decide_rules(hits), "job_id", "left"), best).select(
        "job_id", F.col("final_rank").alias("ocr_rank"), F.col("final_reason").alias("ocr_reason"),
        F.col("final_score").alias("ocr_score"),
    )
    judged = known.join(blocked, "job_id", "left").join(found, "job_id").withColumns(
        {"thin": F.coalesce("thin", F.lit(0)), "blocked": F.coalesce("blocked", F.lit(False))}
    )
    added = hits.select(*ev.EVIDENCE_COLUMNS)
    return lc.resolve_deferred(judged), added, after
