"""Evidence rows and the verdict they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.core import action_of_rank, action_rank, state_of_action, two_decimals
from veilscan.operators.fingerprint import overlap_label

EVIDENCE_COLUMNS = (
    "job_id", "page", "rule_id", "rule_name", "severity", "action", "count", "score", "sample", "tier",
)


def fingerprint_evidence(matches: DataFrame) -> DataFrame:
    """Corpus matches in the shape of rule hits."""
    return matches.select(
        "job_id",
        F.lit(0).alias("page"),
        F.concat(F.lit("fingerprint:"), F.col("document_id").cast("string")).alias("rule_id"),
        F.concat(F.lit("Registered document: "), "document_name").alias("rule_name"),
        "severity", "action",
        F.col("overlap").alias("count"),
        F.col("ratio").alias("score"),
        overlap_label(F.col("ratio")).alias("sample"),
        F.lit("fingerprint").alias("tier"),
    )


def evidence(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """All rows to store for a job; raw matched text is not among the columns."""
    return hits.select(*EVIDENCE_COLUMNS).unionByName(fingerprint_evidence(matches))


def weight(hit: Column) -> Column:
    """What decides between hits: rank, severity, score, then the earlier page and rule."""
    return F.struct(
        action_rank(hit["action"]).alias("rank"), hit["severity"].alias("severity"), hit["score"].alias("score"),
        (-hit["page"]).alias("neg_page"), (-hit["rule_pos"]).alias("neg_pos"),
        hit["rule_name"].alias("name"), hit["count"].alias("times"),
    )


def decision(top: str, score: Column, hits: Column) -> list[Column]:
    """Decision columns of a job from its deciding hit, highest score and number of hits."""
    others = hits - 1
    reason = F.concat(
        F.col(f"{top}.name"), F.lit(" ("), F.col(f"{top}.times").cast("string"), F.lit("x, score "),
        two_decimals(F.col(f"{top}.score")), F.lit(")"),
        F.when(others == 1, F.lit(" and 1 other rule"))
        .when(others > 1, F.concat(F.lit(" and "), others.cast("string"), F.lit(" other rules")))
        .otherwise(F.lit("")),
    )
    return [F.col(f"{top}.rank").alias("rank"), score.alias("score"), reason.alias("reason"), hits.alias("hits")]


def decide_rules(hits: DataFrame) -> DataFrame:
    """Most restrictive action per job and the hit that decides it.

    Among hits of that action the highest (severity, score) decides; on a tie the first in
    hit order, which is page and then rule. One struct maximum does it, so each map task
    sends a single row per job however many hits one job has.
    """
    names = ("action", "severity", "score", "page", "rule_pos", "rule_name", "count")
    top = hits.groupBy("job_id").agg(
        F.max(weight({n: F.col(n) for n in names})).alias("top"), F.max("score").alias("best"), F.count("*").alias("n")
    )
    return top.select("job_id", *decision("top", F.col("best"), F.col("n")))


def decide_in_row(rows: DataFrame, hits: str, keep: Sequence[str]) -> DataFrame:
    """The same where a job is one row that holds its own hits: nothing is shuffled."""
    weighed = rows.select(
        *keep, F.array_max(F.transform(hits, weight)).alias("top"),
        F.array_max(F.transform(hits, lambda h: h["score"])).alias("best"),
        F.coalesce(F.size(hits), F.lit(0)).cast("bigint").alias("n"),
    )
    return weighed.select(*keep, *decision("top", F.col("best"), F.col("n")))


def decide_corpus(matches: DataFrame) -> DataFrame:
    """Most restrictive corpus match per job; among equals the highest ratio, then the
    lowest document id."""
    best = F.min_by(
        F.struct(action_rank(F.col("action")).alias("rank"), "document_name"),
        F.struct(-action_rank(F.col("action")), -F.col("ratio"), F.col("document_id")),
    )
    return matches.groupBy("job_id").agg(best.alias("best"), F.max("ratio").alias("ratio")).select(
        "job_id", F.col("best.rank").alias("match_rank"), F.col("best.document_name").alias("match_name"),
        F.col("ratio").alias("match_ratio"),
    )


def merged(judged: DataFrame, corpus_decisions: DataFrame) -> DataFrame:
    """Fold both kinds of evidence for every job of ``judged``, which has the decision columns
    of its rule hits (nulls where there are none). A corpus match takes over only when it is
    strictly more restrictive; the score is the highest of all."""
    both = judged.join(corpus_decisions, "job_id", "left")
    rule_rank = F.coalesce(F.col("rank"), F.lit(0))
    takes_over = F.coalesce(F.col("match_rank"), F.lit(0)) > rule_rank
    return both.withColumns(
        {
            "final_rank": F.when(takes_over, F.col("match_rank")).otherwise(rule_rank),
            "final_reason": F.when(
                takes_over, F.concat(F.lit("matches registered document '"), "match_name", F.lit("'"))
            ).otherwise(F.coalesce(F.col("reason"), F.lit("no rule matched"))),
            "final_score": F.greatest(
                F.coalesce(F.col("score"), F.lit(0.0)), F.coalesce(F.col("match_ratio"), F.lit(0.0))
            ),
            "rule_hits": F.coalesce(F.col("hits"), F.lit(0).cast("bigint")),
        }
    ).drop("rank", "match_rank", "match_name", "match_ratio", "reason", "score", "hits")


def verdict_columns() -> dict[str, Column]:
    action = action_of_rank(F.col("final_rank"))
    return {"action": action, "state": state_of_action(action)}


def evidence_list(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """Evidence ids per job in order: hits by page and rule, then corpus matches by ratio.
    One row per id with its sort keys, so no job's list is gathered into one task."""
    return hits.select(
        "job_id", F.lit(0).alias("part"), F.col("page").cast("double").alias("k1"),
        F.col("rule_pos").cast("bigint").alias("k2"), "rule_id",
    ).unionByName(
        matches.select(
            "job_id", F.lit(1).alias("part"), (-F.col("ratio")).alias("k1"),
            F.col("document_id").cast("bigint").alias("k2"),
            F.concat(F.lit("fingerprint:"), F.col("document_id").cast("string")).alias("rule_id"),
        )
    )
