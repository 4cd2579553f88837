"""Queries: fingerprints, the registered corpus, evidence and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veilscan.catalog import derived as dv
from veilscan.catalog.derived import (
    CORPUS, CORPUS_MATCHES, GARBLED, HITS, OVERLAP_CTES, STORED_POLICIES, WORDS_SQL, fingerprint_ctes, thin_sql, with_,
)
from veilscan.catalog.registry import query
from veilscan.catalog.scan_sql import scan_cte
from veilscan.functions import text as tx
from veilscan.operators import evidence as ev
from veilscan.operators import fingerprint as fp
from veilscan.operators import lifecycle as lc
from veilscan.operators import policies as po
from veilscan.operators.set_overlap import overlaps
from veilscan.plans import inspect as pl
from veilscan.session import persist_table
from veilscan.sources.rules import shipped_rules

RULES = shipped_rules()
DOCS = "d AS (SELECT doc_id AS job_id, text FROM documents)"
CONV = "d AS (SELECT conv_id AS job_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


@query("normalised_words", with_(DOCS) + f"SELECT job_id, len(ws) AS words, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT job_id, {WORDS_SQL.format('text')} AS ws FROM d)")
def normalised_words(t):
    return dv.documents(t).select("job_id", tx.words(F.col("text")).alias("ws")).select(
        "job_id", F.size("ws").cast("bigint").alias("words"), F.md5(F.array_join("ws", " ")).alias("digest")
    )


@query(
    "shingles",
    with_(DOCS, fingerprint_ctes("d", "job_id", "d"))
    + "SELECT job_id, len(hs) AS shingles, coalesce(list_min(hs), -1) AS lowest, md5(array_to_string(hs, ',')) AS digest FROM d_s",
)
def shingles(t):
    return dv.documents(t).select("job_id", tx.shingle_hashes(F.col("text")).alias("hs")).select(
        "job_id", F.size("hs").cast("bigint").alias("shingles"), F.coalesce(F.array_min("hs"), F.lit(-1)).alias("lowest"),
        F.md5(F.array_join("hs", ",")).alias("digest"),
    )


@query("fingerprints_documents", with_(DOCS, fingerprint_ctes("d", "job_id", "d")) + "SELECT job_id, unnest(fps) AS h, len(fps) AS n FROM d_f")
def fingerprints_documents(t):
    return fp.fingerprint_rows(dv.documents(t))


@query("fingerprints_conversations", with_(CONV, fingerprint_ctes("d", "job_id", "d")) + "SELECT job_id, unnest(fps) AS h, len(fps) AS n FROM d_f")
def fingerprints_conversations(t):
    """Fingerprints of whole conversations, made page by page: shingles cross page breaks."""
    prints = fp.paged_prints(dv.conversations(t))
    return prints.join(fp.sizes(prints), "job_id")


@query("document_text", with_(CONV) + "SELECT job_id, length(text) AS chars, md5(text) AS digest FROM d")
def document_text(t):
    return fp.document_text(dv.conversations(t)).select("job_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


C = (CORPUS, fingerprint_ctes("corpus", "document_id", "c"))


@query(
    "corpus_registered",
    with_(*C) + "SELECT document_id, name, severity, action, sha256(text) AS exact_sha256, len(fps) AS shingle_count, enabled FROM corpus JOIN c_f USING (document_id)",
)
def corpus_registered(t):
    return dv.corpus(t).registered.drop("owner")


@query("corpus_shingle_counts", with_(*C) + "SELECT document_id, len(fps) AS shingle_count FROM c_f")
def corpus_shingle_counts(t):
    return fp.shingle_counts(dv.corpus(t).fingerprints)


@query(
    "corpus_removal",
    with_(*C) + "SELECT document_id, count(*) AS left_over FROM (SELECT document_id, unnest(fps) AS h FROM c_f WHERE document_id % 4 <> 1) GROUP BY document_id",
)
def corpus_removal(t):
    """Documents removed from the corpus take their fingerprints with them."""
    c = dv.corpus(t)
    gone = c.registered.filter("document_id % 4 = 1").select("document_id")
    _, fingerprints = fp.unregister(c.registered, c.fingerprints, gone)
    return fingerprints.groupBy("document_id").agg(F.count("*").alias("left_over"))


@query("corpus_refused", with_(GARBLED) + f"SELECT job_id AS document_id FROM garbled WHERE len({WORDS_SQL.format('text')}) = 0")
def corpus_refused(t):
    """Texts without a single word cannot be registered."""
    docs = dv.garbled(t).select(F.col("job_id").alias("document_id"), F.lit("n").alias("name"), "text")
    return fp.rejected_registrations(docs).select("document_id")


D = (DOCS, fingerprint_ctes("d", "job_id", "d"), *C, OVERLAP_CTES)


def single(t):
    """Documents as single texts."""
    return dv.documents(t).select("job_id", "text")


@query("corpus_overlap", with_(*D) + "SELECT job_id, document_id, overlap FROM ovl")
def corpus_overlap(t):
    c = dv.corpus(t)
    return fp.overlaps(single(t), c.fingerprints, c.registered).select("job_id", "document_id", "overlap")


@query("corpus_matches", with_(*D) + "SELECT job_id, document_id, document_name, severity, action, overlap, round(ratio, 9) AS ratio FROM matches")
def corpus_matches(t):
    c = dv.corpus(t)
    return fp.corpus_matches(single(t), c.registered, c.fingerprints).withColumn("ratio", F.round("ratio", 9))


OWN = """
corpus AS (SELECT doc_id AS document_id, 'doc-' || doc_id AS name, 7 AS severity, 'hold' AS action, true AS enabled, text FROM documents WHERE doc_id % 3 = 0)"""


THRESHOLDS = (0.05, 0.55, 1.0)


@query(
    "corpus_matches_threshold",
    with_(*D) + " UNION ALL ".join(
        f"SELECT job_id, document_id, {x}::DOUBLE AS threshold, overlap FROM found WHERE ratio >= {x}::DOUBLE" for x in THRESHOLDS),
)
def corpus_matches_threshold(t):
    """Matches at several thresholds, each with its own whole-number bounds on what must be shared."""
    c = dv.corpus(t)
    prints = persist_table(fp.print_rows(single(t), "md5").withColumnRenamed("job_id", "id"), "prints")
    corpus = persist_table(fp.enabled_corpus(c.fingerprints, c.registered).withColumnRenamed("document_id", "id"), "corpus")
    return reduce(lambda a, b: a.unionByName(b), [
        fp.members(overlaps(prints, corpus, x)).select("job_id", "document_id", F.lit(x).alias("threshold"), "overlap")
        for x in THRESHOLDS
    ])


ALL_OWN = """
corpus AS (SELECT doc_id AS document_id, 'doc-' || doc_id AS name, 7 AS severity, 'hold' AS action, true AS enabled, text FROM documents)"""


def register_own(docs):
    return fp.register(docs.select(
        F.col("job_id").alias("document_id"), F.concat(F.lit("doc-"), F.col("job_id").cast("string")).alias("name"),
        F.lit("o").alias("owner"), F.lit(7).alias("severity"), F.lit("hold").alias("action"), "text",
    ))


@query(
    "corpus_match_classes",
    with_(DOCS, fingerprint_ctes("d", "job_id", "d"),
          """classes AS (SELECT min(job_id) AS class, count(*) AS members, list_sort(fps) AS fps FROM d_f WHERE len(fps) > 0 GROUP BY list_sort(fps)),
prints AS (SELECT class, members, len(fps) AS n, unnest(fps) AS h FROM classes),
pairs AS (SELECT a.class AS job_class, b.class AS document_class, any_value(a.members) AS jobs, any_value(b.members) AS documents, count(*) AS overlap,
  least(1.0::DOUBLE, greatest(count(*)::DOUBLE / any_value(a.n), count(*)::DOUBLE / any_value(b.n))) AS ratio FROM prints a JOIN prints b USING (h) GROUP BY ALL)""")
    + "SELECT job_class, document_class, jobs, documents, overlap, round(ratio, 9) AS ratio FROM pairs WHERE ratio >= 0.35::DOUBLE",
)
def corpus_match_classes(t):
    """All documents registered and matched with each other, copies counted and not expanded."""
    docs = single(t)
    pairs, _, _ = fp.match_classes(docs, *register_own(docs))
    return pairs.withColumn("ratio", F.round("ratio", 9))


@query(
    "copy_groups",
    "SELECT sha256(text) AS exact_sha256, min(doc_id) AS first_job, count(*) AS jobs, min(doc_id) AS first_document, count(*) AS documents FROM documents GROUP BY 1",
)
def copy_groups(t):
    """Exact copies among all documents, registered as they are, as one row per body."""
    docs = dv.documents(t)
    registered = docs.select(
        F.col("job_id").alias("document_id"), tx.digest(F.col("text")).alias("exact_sha256"), F.lit(True).alias("enabled"))
    return fp.copy_groups(docs, registered)


@query(
    "corpus_matches_large",
    with_(DOCS, fingerprint_ctes("d", "job_id", "d"), OWN, fingerprint_ctes("corpus", "document_id", "c"), OVERLAP_CTES)
    + "SELECT job_id, document_id, document_name, severity, action, overlap, round(ratio, 9) AS ratio FROM matches",
)
def corpus_matches_large(t):
    """A third of the documents registered."""
    docs = single(t)
    own = docs.filter("job_id % 3 = 0").select(
        F.col("job_id").alias("document_id"), F.concat(F.lit("doc-"), F.col("job_id").cast("string")).alias("name"),
        F.lit("o").alias("owner"), F.lit(7).alias("severity"), F.lit("hold").alias("action"), "text",
    )
    registered, fingerprints = fp.register(own)
    return fp.corpus_matches(docs, registered, fingerprints).withColumn("ratio", F.round("ratio", 9))


@query(
    "corpus_matches_ranked",
    with_(CORPUS_MATCHES) + "SELECT job_id, document_id, round(ratio, 9) AS ratio, round(ratio * 100)::INT || '% overlap' AS label FROM matches",
)
def corpus_matches_ranked(t):
    """Matches by ratio with their overlap label."""
    return dv.matches(t).orderBy(F.desc("ratio"), "job_id", "document_id").select(
        "job_id", "document_id", F.round("ratio", 9).alias("ratio"), fp.overlap_label(F.col("ratio")).alias("label")
    )


@query(
    "exact_copies",
    "WITH r AS (SELECT doc_id AS document_id, sha256(text) AS s FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id AS job_id, document_id, s AS exact_sha256 FROM documents d JOIN r ON sha256(d.text) = s",
)
def exact_copies(t):
    docs = dv.documents(t)
    registered = docs.filter("job_id % 2 = 0").select(
        F.col("job_id").alias("document_id"), tx.digest(F.col("text")).alias("exact_sha256"), F.lit(True).alias("enabled")
    )
    return fp.exact_copies(docs, registered)


@query(
    "containment_of_pairs",
    with_(*D) + "SELECT job_id, document_id, round(ratio, 9) AS ratio, overlap AS shared FROM found",
)
def containment_of_pairs(t):
    """Containment of every pair that shares anything, below the threshold too."""
    c = dv.corpus(t)
    return fp.corpus_matches(single(t), c.registered, c.fingerprints, threshold=0.0).select(
        "job_id", "document_id", F.round("ratio", 9).alias("ratio"), F.col("overlap").alias("shared")
    )


# --- evidence and verdicts -------------------------------------------------------------

RANK = "CASE action WHEN 'allow' THEN 0 WHEN 'log' THEN 1 WHEN 'hold' THEN 2 ELSE 3 END"

RULE_VERDICT = f"""
ranked AS (
  SELECT *, {RANK} AS rnk, row_number() OVER (PARTITION BY job_id ORDER BY {RANK} DESC, severity DESC, score DESC, page, rule_pos, rule_name DESC, count DESC) AS place FROM hits),
per_job AS (SELECT job_id, count(*) AS n, max(score) AS score FROM hits GROUP BY job_id),
rv AS (
  SELECT r.job_id, r.rnk, p.score, p.n,
    r.rule_name || ' (' || r.count || 'x, score ' || printf('%.2f', r.score) || ')' ||
      CASE WHEN p.n = 2 THEN ' and 1 other rule' WHEN p.n > 2 THEN ' and ' || (p.n - 1) || ' other rules' ELSE '' END AS reason
  FROM ranked r JOIN per_job p USING (job_id) WHERE place = 1)"""

CORPUS_VERDICT = f"""
cranked AS (SELECT *, {RANK} AS rnk, row_number() OVER (PARTITION BY job_id ORDER BY {RANK} DESC, ratio DESC, document_id) AS place FROM matches),
cv AS (SELECT job_id, rnk AS c_rnk, document_name, (SELECT max(ratio) FROM matches m WHERE m.job_id = cranked.job_id) AS ratio FROM cranked WHERE place = 1)"""

MERGED = """
merged AS (
  SELECT j.*, CASE WHEN coalesce(c_rnk, 0) > coalesce(rnk, 0) THEN c_rnk ELSE coalesce(rnk, 0) END AS final_rank,
    CASE WHEN coalesce(c_rnk, 0) > coalesce(rnk, 0) THEN 'matches registered document ''' || document_name || '''' ELSE coalesce(rv.reason, 'no rule matched') END AS final_reason,
    greatest(coalesce(rv.score, 0), coalesce(cv.ratio, 0)) AS final_score, coalesce(rv.n, 0) AS rule_hits
  FROM j LEFT JOIN rv USING (job_id) LEFT JOIN cv USING (job_id))"""

ACTION = "CASE {0} WHEN 0 THEN 'allow' WHEN 1 THEN 'log' WHEN 2 THEN 'hold' ELSE 'block' END"
STATE = "CASE {0} WHEN 2 THEN 'held' WHEN 3 THEN 'blocked' ELSE 'released' END"


@query("verdict_of_rules", with_(HITS, RULE_VERDICT) + "SELECT job_id, rnk AS rank, round(score, 9) AS score, reason, n AS hits FROM rv")
def verdict_of_rules(t):
    """Most restrictive action and the deciding hit per job."""
    return ev.decide_rules(dv.hits(t)).select("job_id", "rank", F.round("score", 9).alias("score"), "reason", "hits")


@query(
    "verdict_merged",
    with_(HITS, CORPUS_MATCHES, RULE_VERDICT, CORPUS_VERDICT, "j AS (SELECT o_orderkey AS job_id FROM orders)", MERGED)
    + f"SELECT job_id, {ACTION.format('final_rank')} AS action, {STATE.format('final_rank')} AS state, final_rank < 2 AS release, final_reason AS reason, round(final_score, 9) AS score FROM merged",
)
def verdict_merged(t):
    """Rule hits and corpus matches folded for every job, with state and releasability."""
    from veilscan.functions.core import releasable

    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"))
    merged = ev.merged(jobs.join(ev.decide_rules(dv.hits(t)), "job_id", "left"), ev.decide_corpus(dv.matches(t)))
    return merged.withColumns(ev.verdict_columns()).select(
        "job_id", "action", "state", releasable(F.col("action")).alias("release"), F.col("final_reason").alias("reason"), F.round("final_score", 9).alias("score")
    )


@query(
    "evidence_rows",
    with_(HITS, CORPUS_MATCHES)
    + """SELECT job_id, page, rule_id, rule_name, severity, action, count, round(score, 9) AS score, sample, tier FROM hits UNION ALL
SELECT job_id, 0, 'fingerprint:' || document_id, 'Registered document: ' || document_name, severity, action, overlap, round(ratio, 9), round(ratio * 100)::INT || '% overlap', 'fingerprint' FROM matches""",
)
def evidence_rows(t):
    """Both tiers of rule hits and the corpus matches, in one shape."""
    return ev.evidence(dv.hits(t), dv.matches(t)).withColumn("score", F.round("score", 9))


@query(
    "evidence_list",
    with_(HITS, CORPUS_MATCHES)
    + """SELECT job_id, 0 AS part, page::DOUBLE AS k1, rule_pos AS k2, rule_id FROM hits UNION ALL
SELECT job_id, 1, -ratio, document_id, 'fingerprint:' || document_id FROM matches""",
)
def evidence_list(t):
    return ev.evidence_list(dv.hits(t), dv.matches(t))


def governed(t, pages):
    """Pages with the policy of their queue."""
    return po.with_policy(pages, dv.stored_policies(t), po.with_defaults(dv.file_overrides(t)))


FACTS = f"""
j AS (
  SELECT p.job_id, 1 AS page_count, length(text) AS chars, ({thin_sql('text')})::BIGINT AS pages_without_text, y.deep_scan_required
  FROM p JOIN policies y USING (queue))"""

FINISH = f"""
held AS (SELECT *, pages_without_text > 0 AND deep_scan_required AND final_rank < 2 AS waits FROM merged),
verdicts AS (
  SELECT job_id, {ACTION.format('CASE WHEN waits THEN 2 ELSE final_rank END')} AS action, {STATE.format('CASE WHEN waits THEN 2 ELSE final_rank END')} AS state,
    CASE WHEN waits THEN pages_without_text || ' page(s) could not be read as text and this queue requires a deep scan before release' ELSE final_reason END AS reason,
    round(final_score, 9) AS score, CASE WHEN pages_without_text > 0 THEN 'ocr_pending' ELSE 'text' END AS scan_tier, page_count, chars, pages_without_text, rule_hits
  FROM held)"""


def whole(pages: str) -> tuple[str, ...]:
    return (
        pages, STORED_POLICIES, "tagged AS (SELECT p.*, y.tags FROM p JOIN policies y USING (queue))",
        scan_cte("hits", RULES, "tagged", "tags"), "d AS (SELECT job_id, text FROM p)", fingerprint_ctes("d", "job_id", "d"), *C,
        OVERLAP_CTES, RULE_VERDICT, CORPUS_VERDICT, FACTS, MERGED, FINISH,
    )


GARBLED_PAGES = GARBLED.replace("garbled AS", "p AS", 1)


@query("inspect_documents", with_(*whole("p AS (SELECT doc_id AS job_id, 1 AS page, source AS queue, text FROM documents)")) + "SELECT * FROM verdicts")
def inspect_documents(t):
    """The whole path: policy, rules, fingerprints, merge, deep-scan hold, state."""
    result = pl.inspect(governed(t, dv.documents(t)), RULES, dv.corpus(t), single_page=True)
    return result.verdicts.withColumn("score", F.round("score", 9))


@query("inspect_garbled", with_(*whole(GARBLED_PAGES)) + "SELECT * FROM verdicts")
def inspect_garbled(t):
    """The same over documents with unreadable text layers, so that the deferred tier matters."""
    result = pl.inspect(governed(t, dv.garbled(t)), RULES, dv.corpus(t), single_page=True)
    return result.verdicts.withColumn("score", F.round("score", 9))


@query(
    "inspected_events",
    with_(*whole("p AS (SELECT doc_id AS job_id, 1 AS page, source AS queue, text FROM documents)"))
    + "SELECT job_id, 'inspected' AS kind, 'system' AS actor, 'action=' || action || ' score=' || printf('%.2f', score) || ' rules=' || rule_hits AS detail FROM verdicts",
)
def inspected_events(t):
    return pl.inspect(governed(t, dv.documents(t)), RULES, dv.corpus(t), single_page=True).events


CONV_QUEUE = "'src' || (conv_id % 20)"


@query(
    "inspect_conversations",
    with_(
        f"p AS (SELECT conv_id AS job_id, (turn + 1)::INT AS page, {CONV_QUEUE} AS queue, text FROM conversations)", STORED_POLICIES,
        "tagged AS (SELECT p.*, y.tags FROM p JOIN policies y USING (queue))", scan_cte("hits", RULES, "tagged", "tags"),
        CONV, fingerprint_ctes("d", "job_id", "d"), *C, OVERLAP_CTES, RULE_VERDICT, CORPUS_VERDICT,
        f"j AS (SELECT p.job_id, count(*) AS page_count, sum(length(text))::BIGINT AS chars, count(*) FILTER ({thin_sql('text')}) AS pages_without_text, first(y.deep_scan_required) AS deep_scan_required FROM p JOIN policies y USING (queue) GROUP BY p.job_id)",
        MERGED, FINISH,
    )
    + "SELECT * FROM verdicts",
)
def inspect_conversations(t):
    """Multi-page jobs: facts and hits per page, fingerprints over the joined text."""
    pages = dv.conversations(t).withColumn("queue", F.concat(F.lit("src"), (F.col("job_id") % 20).cast("string")))
    return pl.inspect(governed(t, pages), RULES, dv.corpus(t)).verdicts.withColumn("score", F.round("score", 9))


@query("thin_pages", with_(GARBLED) + f"SELECT job_id, page FROM garbled WHERE {thin_sql('text')}")
def thin_pages(t):
    """Pages for the deferred tier, one row each."""
    return dv.garbled(t).filter(tx.is_thin(F.col("text"))).select("job_id", "page")


@query(
    "ocr_batch",
    "SELECT job_id, page FROM (SELECT l_orderkey % 100 AS job_id, l_linenumber * 1000 + l_partkey % 1000 AS page FROM lineitem GROUP BY ALL)",
)
def ocr_batch(t):
    """All thin pages of every job."""
    thin = t.lineitem.select(
        (F.col("l_orderkey") % 100).alias("job_id"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("page")
    ).distinct()
    return lc.ocr_batch(thin)


@query(
    "deferred_tier",
    with_(
        GARBLED_PAGES, STORED_POLICIES,
        "stored_jobs AS (SELECT job_id, CASE job_id % 6 WHEN 0 THEN 'held' WHEN 1 THEN 'released' WHEN 2 THEN 'held' WHEN 3 THEN 'denied_by_analyst' WHEN 4 THEN 'failed_open' ELSE 'blocked' END AS state, CASE job_id % 6 WHEN 1 THEN 'allow' WHEN 4 THEN 'log' WHEN 5 THEN 'block' ELSE 'hold' END AS action, 0.1::DOUBLE AS score, 'before' AS reason FROM p)",
        f"thin AS (SELECT job_id, page FROM p WHERE {thin_sql('text')})",
        "q2 AS (SELECT p.job_id, p.page, p.original AS text, y.tags FROM p JOIN thin USING (job_id, page) JOIN policies y USING (queue))",
        scan_cte("hits", RULES, "q2", "tags"), "d AS (SELECT job_id, text FROM q2)", fingerprint_ctes("d", "job_id", "d"), *C, OVERLAP_CTES,
        RULE_VERDICT, CORPUS_VERDICT, "j AS (SELECT job_id FROM p)", MERGED,
        """judged AS (SELECT s.*, (t.job_id IS NOT NULL) AS looked, s.job_id % 4 = 2 AS blocked, final_rank, final_reason, final_score FROM stored_jobs s JOIN merged USING (job_id) LEFT JOIN thin t USING (job_id)),
flags AS (SELECT *, looked AND final_rank >= 2 AS hit, state IN ('released', 'released_by_analyst', 'failed_open', 'released_then_flagged') AS printed,
  looked AND final_rank < 2 AND state = 'held' AND NOT blocked AS freed FROM judged)""",
    )
    + """SELECT job_id, CASE WHEN hit THEN CASE final_rank WHEN 3 THEN 'block' ELSE 'hold' END ELSE action END AS action,
  CASE WHEN hit AND printed THEN 'released_then_flagged' WHEN hit THEN CASE final_rank WHEN 3 THEN 'blocked' ELSE 'held' END WHEN freed THEN 'released' ELSE state END AS state,
  round(CASE WHEN looked THEN greatest(score, final_score) ELSE score END, 9) AS score,
  CASE WHEN hit AND printed THEN 'OCR found ' || final_reason || ' AFTER the job printed — this queue releases while the deep scan runs (deep_scan_required is off)'
    WHEN hit THEN 'OCR: ' || final_reason WHEN freed THEN 'deep scan clear' ELSE reason END AS reason,
  CASE WHEN NOT looked THEN '' WHEN hit AND printed THEN 'deep_scan_hit_after_release' WHEN hit THEN 'deep_scan_hit' ELSE 'deep_scan_clear' END AS event
FROM flags""",
)
def deferred_tier(t):
    """Unreadable documents re-judged on recognised text, for jobs in every kind of state."""
    docs, k = dv.garbled(t), F.col("job_id")
    jobs = docs.select(
        "job_id",
        F.when(k % 6 == 0, "held").when(k % 6 == 1, "released").when(k % 6 == 2, "held").when(k % 6 == 3, "denied_by_analyst")
        .when(k % 6 == 4, "failed_open").otherwise("blocked").alias("state"),
        F.when(k % 6 == 1, "allow").when(k % 6 == 4, "log").when(k % 6 == 5, "block").otherwise("hold").alias("action"),
        F.lit(0.1).alias("score"), F.lit("before").alias("reason"),
    )
    stored = docs.filter(k % 4 == 2).select("job_id", F.lit("text").alias("tier"), F.lit("hold").alias("action"))
    after, _, _ = pl.deferred(
        jobs, governed(t, docs.select("job_id", "page", "queue", "text")),
        docs.select("job_id", "page", F.col("original").alias("text")), stored, RULES, dv.corpus(t),
        single_page=True,
    )
    return after.select("job_id", "action", "state", F.round("score", 9).alias("score"), "reason", F.coalesce("event", F.lit("")).alias("event"))


@query("recognised_pages", with_(GARBLED) + f"SELECT job_id, page, md5(CASE WHEN {thin_sql('text')} AND job_id % 2 = 1 THEN original ELSE text END) AS digest FROM garbled")
def recognised_pages(t):
    docs = dv.garbled(t)
    recognised = docs.filter(tx.is_thin(F.col("text")) & (F.col("job_id") % 2 == 1)).select("job_id", "page", F.col("original").alias("text"))
    return lc.recognised_pages(docs.select("job_id", "page", "text"), recognised).select("job_id", "page", F.md5("text").alias("digest"))


@query("blocked_before", with_(HITS) + "SELECT DISTINCT job_id FROM hits WHERE tier <> 'ocr' AND action IN ('hold', 'block')")
def blocked_before(t):
    return lc.blocked_before(dv.hits(t))


PARTIAL = "partial AS (SELECT job_id, rnk, reason FROM rv)"


@query(
    "failure_resolution",
    with_(HITS, RULE_VERDICT, PARTIAL, "f AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'closed' ELSE 'open' END AS fail_mode FROM orders)",
          "x AS (SELECT f.*, coalesce(p.rnk, 0) AS r, p.reason, CASE fail_mode WHEN 'closed' THEN 2 ELSE 1 END AS base FROM f LEFT JOIN partial p USING (job_id))")
    + """SELECT job_id, CASE WHEN r > base THEN CASE r WHEN 3 THEN 'block' ELSE 'hold' END WHEN fail_mode = 'closed' THEN 'hold' ELSE 'log' END AS action,
  CASE WHEN r > base THEN CASE r WHEN 3 THEN 'blocked' ELSE 'held' END WHEN fail_mode = 'closed' THEN 'held' ELSE 'failed_open' END AS state,
  CASE WHEN r > base THEN reason || ' (partial scan: deadline exceeded)' ELSE 'deadline exceeded' END AS reason, 'fail_' || fail_mode AS event FROM x""",
)
def failure_resolution(t):
    """Failed inspections: the fail mode decides unless a partial hit is stricter."""
    failed = t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.lit("deadline exceeded").alias("failure"),
        F.struct(F.when(F.col("o_custkey") % 3 == 0, "closed").otherwise("open").alias("fail_mode")).alias("policy"),
    )
    partial = ev.decide_rules(dv.hits(t)).select("job_id", "rank", F.col("reason").alias("matched_reason"))
    return lc.resolve_failure(failed.join(partial, "job_id", "left"))


@query(
    "unreadable_resolution",
    with_("u AS (SELECT page_id AS job_id, page_id % 5 = 0 AS encrypted, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'binary' END AS format, CASE page_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'log' WHEN 2 THEN 'hold' ELSE 'block' END AS action FROM pages)")
    + "SELECT job_id, action, CASE action WHEN 'hold' THEN 'held' WHEN 'block' THEN 'blocked' ELSE 'released' END AS state, 'unreadable' AS scan_tier, 'document is ' || CASE WHEN encrypted THEN 'encrypted' ELSE 'unreadable (' || format || ')' END || '; queue policy says ' || action AS reason FROM u",
)
def unreadable_resolution(t):
    k = F.col("page_id")
    action = F.when(k % 4 == 0, "allow").when(k % 4 == 1, "log").when(k % 4 == 2, "hold").otherwise("block")
    return lc.resolve_unreadable(
        t.pages.select(
            k.alias("job_id"), (k % 5 == 0).alias("encrypted"), F.when(k % 2 == 0, "pdf").otherwise("binary").alias("format"),
            F.struct(action.alias("on_unreadable")).alias("policy"),
        )
    )


@query(
    "oversize_bypass",
    "SELECT doc_id AS job_id, octet_length(encode(text)) AS byte_size, CASE WHEN octet_length(encode(text)) <= 4000 THEN 'inspect' WHEN doc_id % 3 = 0 THEN 'hold' ELSE 'release uninspected' END AS outcome FROM documents",
)
def oversize_bypass(t):
    size = F.octet_length("text").cast("bigint")
    mode = F.when(F.col("doc_id") % 3 == 0, "closed").otherwise("open")
    return t.documents.select(
        F.col("doc_id").alias("job_id"), size.alias("byte_size"), F.coalesce(lc.oversize(size, mode, 4000), F.lit("inspect")).alias("outcome")
    )
