"""Queries: sources, page predicates, checks, dialect, and the rule scan."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilscan.catalog import derived as dv
from veilscan.catalog.derived import GARBLED, PLANTED, language_sql, strip_sql, thin_sql, with_
from veilscan.catalog.registry import query
from veilscan.catalog.scan_sql import CHECK_SQL, quoted, scan_cte
from veilscan.functions import checks
from veilscan.functions import text as tx
from veilscan.functions.checks import register_check
from veilscan.functions.dialect import to_java
from veilscan.operators import lifecycle as lc
from veilscan.operators import rule_admin as ra
from veilscan.operators.scan import scan_pages
from veilscan.session import shared_dir
from veilscan.sources.documents import paged
from veilscan.sources.rules import Rule, nested, rules_from_files, rules_table, shipped_rules

RULES = shipped_rules()
HIT = "job_id, page, rule_id, rule_name, severity, action, count, round(score, 9) AS score, sample, contexts, rule_pos"


def shown(hits):
    return hits.select(
        "job_id", "page", "rule_id", "rule_name", "severity", "action", "count", F.round("score", 9).alias("score"),
        "sample", F.array_join("contexts", ",").alias("contexts"), "rule_pos",
    )


@query(
    "intake",
    """
SELECT doc_id AS job_id, source AS queue, repeat('Report ' || doc_id || ' ', 80) AS title,
  CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'ws-' || (doc_id % 50) || '.example' END AS hostname,
  octet_length(encode(text)) AS byte_size, sha256(text) AS content_sha256, 'inspecting' AS state,
  strftime(TIMESTAMP '2024-02-25 00:00:00' + to_minutes(doc_id * 7), '%Y/%m/%d') || '/' || doc_id || '.bin' AS archive_key,
  strftime(TIMESTAMP '2024-02-25 00:00:00' + to_minutes(doc_id * 7) + to_days(90), '%Y-%m-%d %H:%M:%S') AS purge_after
FROM documents""",
)
def intake(t):
    k = F.col("doc_id")
    host = F.concat(F.lit("ws-"), (k % 50).cast("string"), F.lit(".example"))
    options = (
        F.when(k % 3 == 0, F.concat(F.lit("copies=1 job-originating-host-name="), host, F.lit(" sides=one")))
        .when(k % 3 == 1, F.concat(F.lit("job-originating-host-name='"), host, F.lit("'")))
        .otherwise(F.lit("x-job-originating-host-name=fake sides=two"))
    )
    submitted = t.documents.select(
        k.alias("job_id"), F.col("source").alias("queue"),
        F.repeat(F.concat(F.lit("Report "), k.cast("string"), F.lit(" ")), 80).alias("title"),
        options.alias("options"), F.col("text").alias("body"),
        (F.lit("2024-02-25 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int") * 7)).alias("created_at"),
    )
    return lc.intake(submitted).select(
        "job_id", "queue", "title", "hostname", "byte_size", "content_sha256", "state", "archive_key",
        F.date_format("purge_after", "yyyy-MM-dd HH:mm:ss").alias("purge_after"),
    )


@query(
    "pages_of_documents",
    """
SELECT job_id, i AS page, length(parts[i]) AS chars FROM (
  SELECT job_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id AS job_id, string_split(text, chr(10)) AS parts FROM documents))""",
)
def pages_of_documents(t):
    """Numbered pages of each document; its line feeds stand in for page breaks."""
    broken = t.documents.select(F.col("doc_id").alias("job_id"), F.translate("text", "\n", "\f").alias("text"))
    return paged(broken).select("job_id", F.col("page").cast("bigint").alias("page"), F.length("text").cast("bigint").alias("chars"))


@query(
    "page_facts_per_job",
    with_("p AS (SELECT conv_id AS job_id, text FROM conversations)")
    + f"SELECT job_id, count(*) AS page_count, sum(length(text))::BIGINT AS chars, count(*) FILTER ({thin_sql('text')}) AS pages_without_text FROM p GROUP BY job_id",
)
def page_facts_per_job(t):
    from veilscan.plans.inspect import page_facts

    return page_facts(dv.conversations(t))


@query(
    "page_readability",
    with_(GARBLED)
    + f"""
SELECT job_id, {strip_sql('text')} = '' AS blank, {language_sql('text')} AS language, {thin_sql('text')} AS thin,
  length({strip_sql('text')}) >= 20 AND NOT {language_sql('text')} AS misencoded FROM garbled""",
)
def page_readability(t):
    x = F.col("text")
    return dv.garbled(t).select(
        "job_id", tx.is_blank(x).alias("blank"), tx.looks_like_language(x).alias("language"),
        tx.is_thin(x).alias("thin"), tx.is_misencoded(x).alias("misencoded"),
    )


@query(
    "body_formats",
    """
WITH b AS (
  SELECT page_id, CASE page_id % 9
    WHEN 0 THEN hex(encode('%PDF-1.7' || html)) WHEN 1 THEN hex(encode('%!PS-Adobe' || html))
    WHEN 2 THEN '1B' || hex(encode('%-12345X@PJL' || html)) WHEN 3 THEN '1B45' || hex(encode(html))
    WHEN 4 THEN hex(encode('junk %PDF' || html)) WHEN 5 THEN hex(encode('x')) || '00' || hex(encode(html))
    WHEN 6 THEN hex(encode('abc')) || 'FF' || hex(encode(html)) WHEN 7 THEN hex(encode(repeat('é', (page_id % 2 + 1)::INT) || repeat('a', (1019 + page_id % 4)::INT) || 'é'))
    ELSE hex(encode(html)) END AS x FROM pages),
h AS (SELECT page_id, x, x AS head FROM b)
SELECT page_id, CASE WHEN starts_with(head, '25504446') THEN 'pdf' WHEN starts_with(head, '25215053') THEN 'postscript'
    WHEN starts_with(head, '1B252D313233343558') OR starts_with(head, '1B45') THEN 'pcl'
    WHEN regexp_matches(head, '^(..)*25504446') THEN 'pdf' WHEN regexp_matches(head, '^(..)*00') THEN 'binary'
    WHEN try(decode(unhex(head))) IS NULL THEN 'binary' ELSE 'text' END AS format,
  ' first bytes: ' || array_to_string(regexp_extract_all(lower(substring(x, 1, 32)), '..'), ' ') || ' |' ||
    array_to_string(list_transform(regexp_extract_all(substring(x, 1, 32), '..'), lambda p: CASE WHEN ('0x' || p)::INT BETWEEN 32 AND 126 THEN chr(('0x' || p)::INT) ELSE '.' END), '') || '|' AS magic
FROM h""",
)
def body_formats(t):
    """Format census of raw bodies; every ninth body gets a different leading sequence."""
    kind, html = F.col("page_id") % 9, F.encode(F.col("html"), "UTF-8")

    def led(prefix: bytes):
        return F.concat(F.lit(prefix), html)

    cut = F.encode(
        F.concat(F.repeat(F.lit("é"), (F.col("page_id") % 2 + 1).cast("int")), F.repeat(F.lit("a"), (F.col("page_id") % 4 + 1019).cast("int")), F.lit("é")), "UTF-8"
    )
    body = (
        F.when(kind == 0, led(b"%PDF-1.7")).when(kind == 1, led(b"%!PS-Adobe")).when(kind == 2, led(b"\x1b%-12345X@PJL"))
        .when(kind == 3, led(b"\x1bE")).when(kind == 4, led(b"junk %PDF")).when(kind == 5, led(b"x\x00"))
        .when(kind == 6, led(b"abc\xff")).when(kind == 7, cut).otherwise(html)
    )
    return t.pages.select("page_id", body.alias("body")).select(
        "page_id", tx.sniff_format(F.col("body")).alias("format"), tx.magic(F.col("body")).alias("magic")
    )


# --- checks ----------------------------------------------------------------------------

CANDIDATES = """
v AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 6
    WHEN 0 THEN '4' || lpad((o_custkey * 7919 + o_orderkey)::VARCHAR, 15, '0')
    WHEN 1 THEN lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || lpad((o_custkey * 3 % 10000)::VARCHAR, 4, '0')
    WHEN 2 THEN lpad((o_custkey * 104729 + o_orderkey)::VARCHAR, 10, '0')
    WHEN 3 THEN 'GB' || lpad((o_orderkey % 97 + 2)::VARCHAR, 2, '0') || 'West ' || lpad((o_custkey * 31)::VARCHAR, 14, '0')
    WHEN 4 THEN ' ' || substring(md5(o_orderkey::VARCHAR), 1, (10 + o_custkey % 14)::INT) || ' '
    ELSE repeat(substring('abcdefgh', 1, (1 + o_custkey % 8)::INT), (1 + o_orderkey % 12)::INT) END AS raw
  FROM orders)"""


def candidates(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pad(value, n):
        return F.lpad(value.cast("string"), n, "0")

    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("4"), pad(c * 7919 + k, 15)))
        .when(k % 6 == 1, F.concat_ws("-", pad(c % 1000, 3), pad(k % 100, 2), pad((c * 3) % 10000, 4)))
        .when(k % 6 == 2, pad(c * 104729 + k, 10))
        .when(k % 6 == 3, F.concat(F.lit("GB"), pad(k % 97 + 2, 2), F.lit("West "), pad(c * 31, 14)))
        .when(k % 6 == 4, F.concat(F.lit(" "), F.substr(F.md5(k.cast("string")), F.lit(1), (c % 14 + 10).cast("int")), F.lit(" ")))
        .otherwise(F.repeat(F.substr(F.lit("abcdefgh"), F.lit(1), (c % 8 + 1).cast("int")), (k % 12 + 1).cast("int")))
    )
    return t.orders.select(k.alias("k"), raw.alias("raw"))


def register_check_query(name: str) -> None:
    @query(f"check_{name}", with_(CANDIDATES) + f"SELECT k, raw, {CHECK_SQL[name]('raw')} AS passes FROM v")
    def run(t):
        return candidates(t).select("k", "raw", checks.check_named(name)(F.col("raw")).alias("passes"))


for check_name in ("luhn", "iban", "us_ssn", "nhs_number", "mod11", "entropy", "none"):
    register_check_query(check_name)


@query(
    "check_by_name",
    with_(CANDIDATES)
    + f"""
SELECT k, name, coalesce(CASE name WHEN 'luhn' THEN {CHECK_SQL['luhn']('raw')} WHEN 'iban' THEN {CHECK_SQL['iban']('raw')}
  WHEN 'entropy' THEN {CHECK_SQL['entropy']('raw')} WHEN '' THEN true END::VARCHAR, 'unknown') AS passes
FROM (SELECT *, CASE k % 5 WHEN 0 THEN 'luhn' WHEN 1 THEN 'iban' WHEN 2 THEN 'entropy' WHEN 3 THEN '' ELSE 'nosuch' END AS name FROM v)""",
)
def check_by_name(t):
    k = F.col("k")
    name = F.when(k % 5 == 0, "luhn").when(k % 5 == 1, "iban").when(k % 5 == 2, "entropy").when(k % 5 == 3, "").otherwise("nosuch")
    return candidates(t).select("k", name.alias("name"), F.coalesce(checks.dispatch(name, F.col("raw")).cast("string"), F.lit("unknown")).alias("passes"))


# --- dialect ---------------------------------------------------------------------------

# Patterns that read differently in the two regex dialects, tried on accented prose.
DIALECT = (
    (r"\b[a-z]{2,4}\b", False), (r"\bth\w*", True), (r"\w+\s\w+\s", False), (r"[^\s,]+[.,]", False),
    (r"\Bou\B", True), (r"[[:upper:]][[:lower:]]+", False), (r"\S+$", False), (r"^\w+", False), (r"e.t", True),
    (r"(?:é|è)\b", False), (r"[A-Z&&]+", False), (r"\pL{9,}", False), (r"st", True),
    (r"(?P<head>th)\w", True), (r"\Q.\E\s", False), (r"\x{65}.|\x61n", False), (r"(?U)\w+a{1,2} ", False), (r"a(?i)N", False),
    (r"(?i)[^i]n", False), (r"(?m)^\w+$", False), (r"(?U:e\w+)n|\w+s$", False),
)


@query(
    "dialect_matches",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, {n} AS pattern_no, len(m) AS found, md5(array_to_string(m, '|')) AS joined FROM (SELECT doc_id, regexp_extract_all(text, {quoted(('(?i)' if i else '') + p)}) AS m FROM documents)"
        for n, (p, i) in enumerate(DIALECT)
    ) + ")",
)
def dialect_matches(t):
    """All matches of rewritten patterns, compared with an engine of the original dialect."""
    found = F.array(
        *[
            F.struct(F.lit(n).alias("pattern_no"), F.regexp_extract_all("text", F.lit(to_java(p, i)), F.lit(0)).alias("m"))
            for n, (p, i) in enumerate(DIALECT)
        ]
    )
    return t.documents.select("doc_id", "text").select("doc_id", F.explode_outer(found).alias("f")).select(
        "doc_id", "f.pattern_no", F.size("f.m").cast("bigint").alias("found"), F.md5(F.array_join("f.m", "|")).alias("joined")
    )


CUSTOM = [
    Rule("every-the", "The word the", r"\bthe\b", action="log", severity=1, base_confidence=0.8, min_count=3,
         terms=("and", "Of", "is"), window=12, boost=0.15, sample_prefix=1, sample_suffix=0),
    Rule("long-word", "Long word", r"\b\w{12,}\b", severity=2, base_confidence=0.5, threshold=0.7, validator="none",
         terms=("é", "è"), window=25, required=True, sample_prefix=2, sample_suffix=3),
    Rule("always-on", "Fires without a match", r"zz9zz9", severity=0, base_confidence=0.9, min_count=0),
]


# --- scans -----------------------------------------------------------------------------


@query(
    "scan_documents",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", RULES, "p")) + f"SELECT {HIT} FROM h",
)
def scan_documents(t):
    """The whole shipped pack over all documents."""
    return shown(scan_pages(dv.documents(t), RULES))


@query(
    "scan_conversations",
    with_("p AS (SELECT conv_id AS job_id, (turn + 1)::INT AS page, text FROM conversations)", scan_cte("h", RULES + CUSTOM[:2], "p")) + f"SELECT {HIT} FROM h",
)
def scan_conversations(t):
    return shown(scan_pages(dv.conversations(t), RULES + CUSTOM[:2]))


@query("scan_planted", with_(PLANTED, scan_cte("h", RULES, "planted")) + f"SELECT {HIT} FROM h")
def scan_planted(t):
    """The pack over one text per order, which holds identifiers of every kind."""
    return shown(scan_pages(dv.planted(t), RULES))


PLANTED_TAGS = """
tagged AS (SELECT *, CASE custkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'pci,secrets' WHEN 2 THEN 'pii' ELSE 'nosuch' END AS tags FROM planted)"""


@query("scan_by_tag", with_(PLANTED, PLANTED_TAGS, scan_cte("h", RULES, "tagged", "tags")) + f"SELECT {HIT} FROM h")
def scan_by_tag(t):
    """Rules scoped per row by tags: all, two groups, one group, none."""
    c = F.col("custkey")
    tags = (
        F.when(c % 4 == 0, F.array(F.lit("*"))).when(c % 4 == 1, F.array(F.lit("pci"), F.lit("secrets")))
        .when(c % 4 == 2, F.array(F.lit("pii"))).otherwise(F.array(F.lit("nosuch")))
    )
    return shown(scan_pages(dv.planted(t).withColumn("tags", tags), RULES, tags="tags"))


@query(
    "scan_custom_rules",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", CUSTOM[:2], "p"),
          f"b AS (SELECT doc_id AS job_id, 1 AS page, 'always-on' AS rule_id, 'Fires without a match' AS rule_name, 0 AS severity, 'log' AS action, 0 AS count, 0.0::DOUBLE AS score, '' AS sample, '' AS contexts, 0 AS rule_pos FROM documents WHERE {strip_sql('text')} <> '')")
    + f"SELECT {HIT.replace('rule_pos', 'rule_pos + 1 AS rule_pos')} FROM h UNION ALL SELECT {HIT} FROM b",
)
def scan_custom_rules(t):
    """Own rules as data: many matches per page, context edges, and a minimum of zero."""
    return shown(scan_pages(dv.documents(t), CUSTOM))


@query(
    "scan_rules_from_table",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", RULES, "p")) + f"SELECT {HIT} FROM h",
)
def scan_rules_from_table(t):
    """The pack stored as a rules table, read back and planned into the same scan."""
    from veilscan.sources.rules import rules_from_table

    return shown(scan_pages(dv.documents(t), rules_from_table(rules_table(t.spark, RULES))))


@query(
    "scan_rules_from_files",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", RULES, "p")) + f"SELECT {HIT} FROM h",
)
def scan_rules_from_files(t):
    """The pack as files in the shared folder, loaded from there and planned into the same scan."""
    folder = shared_dir(t.spark, "packs")
    halves = [[nested(r) for r in RULES[k::2]] for k in (0, 1)]
    packs = t.spark.createDataFrame([(json.dumps({"rules": half}),) for half in halves], "value string")
    packs.repartition(2).write.text(folder)
    return shown(scan_pages(dv.documents(t), rules_from_files(t.spark, folder)))


# A check of one's own, as a column function and in SQL.
register_check("even_length", lambda value: F.length(value) % 2 == 0)
CHECK_SQL["even_length"] = lambda value: f"length({value}) % 2 = 0"
OWN_CHECK = Rule("even-word", "Long word of even length", r"\b\w{8,}\b", severity=3, base_confidence=0.4, validator="even_length", validator_weight=0.3,
                 threshold=0.6, sample_prefix=1, sample_suffix=1)


@query(
    "scan_own_validator",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", [OWN_CHECK], "p")) + f"SELECT {HIT} FROM h",
)
def scan_own_validator(t):
    """A rule whose check was registered by its user."""
    return shown(scan_pages(dv.documents(t), [OWN_CHECK]))


@query(
    "try_candidate_rule",
    with_("p AS (SELECT doc_id AS job_id, 1 AS page, text FROM documents)", scan_cte("h", [CUSTOM[1]], "p"))
    + "SELECT job_id, page, count, round(score, 3) AS score, sample, action FROM h",
)
def try_candidate_rule(t):
    return ra.try_rule(CUSTOM[1], dv.documents(t))


FIXTURES = """
fixtures AS (
  SELECT CASE job_id % 3 WHEN 0 THEN 'pan-loose' WHEN 1 THEN 'us-ssn' ELSE 'generic-secret-assignment' END AS rule_id,
    CASE WHEN custkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind, text, job_id, 1 AS page FROM planted)"""


def planted_fixtures(t):
    k, c = F.col("job_id"), F.col("custkey")
    return dv.planted(t).select(
        F.when(k % 3 == 0, "pan-loose").when(k % 3 == 1, "us-ssn").otherwise("generic-secret-assignment").alias("rule_id"),
        F.when(c % 2 == 0, "positive").otherwise("negative").alias("kind"), "text",
    )


FAILED_FIXTURES = """
fired AS (SELECT DISTINCT f.rule_id, f.kind, f.text FROM fixtures f JOIN h ON h.job_id = f.job_id AND h.rule_id = f.rule_id),
failed AS (
  SELECT f.rule_id, CASE WHEN f.kind = 'positive' THEN 'false-negative' ELSE 'false-positive' END AS kind, f.text
  FROM fixtures f LEFT JOIN fired d ON d.rule_id = f.rule_id AND d.kind = f.kind AND d.text = f.text
  WHERE (f.kind = 'positive') = (d.rule_id IS NULL))"""


@query("fixture_failures", with_(PLANTED, FIXTURES, scan_cte("h", RULES, "fixtures"), FAILED_FIXTURES) + "SELECT * FROM failed")
def fixture_failures(t):
    return ra.fixture_failures(planted_fixtures(t), RULES)


@query(
    "fixture_gate",
    with_(PLANTED, FIXTURES, scan_cte("h", RULES, "fixtures"), FAILED_FIXTURES)
    + "SELECT DISTINCT rule_id AS id FROM fixtures EXCEPT SELECT rule_id FROM failed WHERE rule_id <> 'us-ssn'",
)
def fixture_gate(t):
    """Rules that keep their place once failures (here: of all rules but one) are known."""
    fixtures = planted_fixtures(t)
    failures = ra.fixture_failures(fixtures, RULES).filter("rule_id <> 'us-ssn'")
    table = fixtures.select(F.col("rule_id").alias("id"), F.lit(True).alias("enabled")).distinct()
    return ra.passing_rules(table, failures).select("id")
