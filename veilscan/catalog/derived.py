"""Model tables derived from the driver tables, in Spark and in SQL side by side.

Every rule below is arithmetic on keys, so both engines produce the same rows and the tables
grow with their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.catalog.registry import Tables

# --- documents -------------------------------------------------------------------------


def documents(t: Tables) -> DataFrame:
    """Single-page jobs."""
    return t.documents.select(F.col("doc_id").alias("job_id"), F.lit(1).alias("page"), "text", F.col("source").alias("queue"))


def conversations(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def garbled(t: Tables) -> DataFrame:
    """Documents of which some carry a text layer that is not language."""
    return garbled_of(t.documents)


def garbled_of(documents: DataFrame) -> DataFrame:
    kind = F.col("doc_id") % 7
    return documents.select(
        F.col("doc_id").alias("job_id"), F.lit(1).alias("page"), F.col("source").alias("queue"),
        F.when(kind == 1, F.regexp_replace("text", "[A-Za-zÀ-ɏ]", "#"))
        .when(kind == 2, F.substring("text", 1, 15))
        .when(kind == 3, F.lit(" \t\n"))
        .when(kind == 4, F.concat(F.lit("\u00a0 "), F.regexp_replace("text", "[aeiouAEIOU]", "7"), F.lit("\n\u2003")))
        .otherwise(F.col("text")).alias("text"),
        F.col("text").alias("original"),
    )


GARBLED = """
garbled AS (
  SELECT doc_id AS job_id, 1 AS page, source AS queue, text AS original,
    CASE doc_id % 7
      WHEN 1 THEN regexp_replace(text, '[A-Za-zÀ-ɏ]', '#', 'g')
      WHEN 2 THEN substring(text, 1, 15)
      WHEN 3 THEN ' ' || chr(9) || chr(10)
      WHEN 4 THEN chr(160) || ' ' || regexp_replace(text, '[aeiouAEIOU]', '7', 'g') || chr(10) || chr(8195)
      ELSE text END AS text
  FROM documents)"""

# White space at the ends of a text, by code point.
BLANK_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
BLANK_SQL = "||".join(f"chr({c})" for c in BLANK_CODES)


def strip_sql(value: str) -> str:
    return f"trim({value}, {BLANK_SQL})"


def language_sql(value: str) -> str:
    s = strip_sql(value)
    return (
        f"({s} <> '' AND (len(list_filter(regexp_extract_all({s}, '[A-Za-z]{{3,}}'), lambda w: regexp_matches(w, '[aeiouAEIOU]'))) >= 3"
        f" OR length(regexp_replace({s}, '[^\\pL]', '', 'g'))::DOUBLE / length({s}) >= 0.30::DOUBLE))"
    )


def thin_sql(value: str) -> str:
    return f"(length({strip_sql(value)}) < 20 OR NOT {language_sql(value)})"


def planted(t: Tables) -> DataFrame:
    """One text per order, with identifiers of many kinds made from its keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def digits(value, n):
        return F.lpad(value.cast("string"), n, "0")

    ssn = F.concat_ws("-", digits(c % 1000, 3), digits(k % 100, 2), digits(k % 10000, 4))
    nhs = F.concat_ws(" ", digits((k * 7) % 1000, 3), digits((c * 11) % 1000, 3), digits((k * 13 + c) % 10000, 4))
    card = F.concat(F.lit("4"), digits(k % 10000000, 7), digits((c * 31 + k) % 100000000, 8))
    spaced = F.concat_ws(" ", F.lit("4000"), digits(k % 10000, 4), digits(c % 10000, 4), digits((k + c) % 10000, 4))
    iban = F.concat(F.lit("DE"), digits(k % 97 + 2, 2), digits(c, 8), digits(k % 10000000000, 10))
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(k.cast("string")), 1, 16)))
    text = (
        F.when(k % 11 == 0, F.concat(F.lit("Employee file: SSN "), ssn, F.lit(" and again "), ssn))
        .when(k % 11 == 1, F.concat(F.lit("The patient with number "), nhs, F.lit(" was seen at the hospital")))
        .when(k % 11 == 2, F.concat(F.lit("éé"), card, F.lit(" paid by Visa card; spare "), card, F.lit(", cvv 123")))
        .when(k % 11 == 3, F.concat(F.lit("Payment card on file "), spaced, F.lit(".")))
        .when(k % 11 == 4, F.concat(F.lit("bank transfer to "), iban, F.lit(" please")))
        .when(k % 11 == 5, F.concat(F.lit("prod server paſſword: "), F.md5(c.cast("string")), F.lit("\nTOKEN ="), k.cast("string"), F.lit("-zzzzzzzz")))
        .when(k % 11 == 6, F.concat(F.lit("key "), key, F.lit("\n-----BEGIN "), F.when(c % 2 == 0, "RSA ").otherwise(""), F.lit("PRIVATE KEY-----")))
        .when(k % 11 == 7, F.concat(F.lit("Date of birth 01/02/19"), digits(k % 100, 2), F.lit(" DOB: 3-4-1980 d.o.b. 5.6.70 passport X"), digits(k, 7)))
        .when(k % 11 == 8, F.repeat(F.concat(F.lit("annual bonus grade "), c.cast("string"), F.lit("; ")), (c % 12 + 1).cast("int")))
        .when(k % 11 == 9, F.concat(F.repeat(F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.example.org, ")), (c % 60 + 1).cast("int")), F.lit("SWIFT BNPAFRPP wire COBADEFF")))
        .otherwise(F.concat(F.lit("STRICTLY  Confidential draft merger memo "), k.cast("string"), F.lit(" under embargo")))
    )
    return t.orders.select("o_orderkey", "o_custkey").select(k.alias("job_id"), F.lit(1).alias("page"), text.alias("text"), c.alias("custkey"))


PLANTED = """
planted AS (
  SELECT o_orderkey AS job_id, 1 AS page, o_custkey AS custkey, CASE o_orderkey % 11
    WHEN 0 THEN 'Employee file: SSN ' || ssn || ' and again ' || ssn
    WHEN 1 THEN 'The patient with number ' || nhs || ' was seen at the hospital'
    WHEN 2 THEN 'éé' || card || ' paid by Visa card; spare ' || card || ', cvv 123'
    WHEN 3 THEN 'Payment card on file ' || spaced || '.'
    WHEN 4 THEN 'bank transfer to ' || iban || ' please'
    WHEN 5 THEN 'prod server pa' || chr(383) || chr(383) || 'word: ' || md5(o_custkey::VARCHAR) || chr(10) || 'TOKEN =' || o_orderkey || '-zzzzzzzz'
    WHEN 6 THEN 'key AKIA' || upper(substring(md5(o_orderkey::VARCHAR), 1, 16)) || chr(10) || '-----BEGIN ' || CASE WHEN o_custkey % 2 = 0 THEN 'RSA ' ELSE '' END || 'PRIVATE KEY-----'
    WHEN 7 THEN 'Date of birth 01/02/19' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' DOB: 3-4-1980 d.o.b. 5.6.70 passport X' || lpad(o_orderkey::VARCHAR, 7, '0')
    WHEN 8 THEN repeat('annual bonus grade ' || o_custkey || '; ', (o_custkey % 12 + 1)::INT)
    WHEN 9 THEN repeat('u' || o_orderkey || '@mail.example.org, ', (o_custkey % 60 + 1)::INT) || 'SWIFT BNPAFRPP wire COBADEFF'
    ELSE 'STRICTLY  Confidential draft merger memo ' || o_orderkey || ' under embargo' END AS text
  FROM (SELECT o_orderkey, o_custkey,
    lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS ssn,
    lpad(((o_orderkey * 7) % 1000)::VARCHAR, 3, '0') || ' ' || lpad(((o_custkey * 11) % 1000)::VARCHAR, 3, '0') || ' ' || lpad(((o_orderkey * 13 + o_custkey) % 10000)::VARCHAR, 4, '0') AS nhs,
    '4' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') || lpad(((o_custkey * 31 + o_orderkey) % 100000000)::VARCHAR, 8, '0') AS card,
    '4000 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' ' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' ' || lpad(((o_orderkey + o_custkey) % 10000)::VARCHAR, 4, '0') AS spaced,
    'DE' || lpad((o_orderkey % 97 + 2)::VARCHAR, 2, '0') || lpad(o_custkey::VARCHAR, 8, '0') || lpad((o_orderkey % 10000000000)::VARCHAR, 10, '0') AS iban
    FROM orders))"""

# --- jobs, evidence, events ------------------------------------------------------------

JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id, 'user' || (o_custkey % 50) AS username, 'q' || (o_custkey % 9) AS queue,
    (o_orderkey % 97)::VARCHAR AS cups_job_id, 'body-' || (o_custkey % 5) AS content_sha256,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'released' WHEN 1 THEN 'released_by_analyst' WHEN 2 THEN 'failed_open' ELSE 'released_then_flagged' END
         WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 2 THEN 'blocked' ELSE 'held' END
         ELSE CASE o_orderkey % 2 WHEN 0 THEN 'inspecting' ELSE 'denied_by_analyst' END END AS state,
    o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
    'reason ' || (o_orderkey % 13) AS verdict_reason,
    (o_orderkey * 37) % 347 AS inline_ms,
    CASE o_custkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'ocr_complete' ELSE 'ocr_pending' END AS scan_tier,
    o_orderkey % 17 = 0 AS purged
  FROM orders)"""


def jobs(t: Tables) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    state = (
        F.when(s == "F", F.when(k % 4 == 0, "released").when(k % 4 == 1, "released_by_analyst")
               .when(k % 4 == 2, "failed_open").otherwise("released_then_flagged"))
        .when(s == "O", F.when(k % 3 == 2, "blocked").otherwise("held"))
        .otherwise(F.when(k % 2 == 0, "inspecting").otherwise("denied_by_analyst"))
    )
    return t.orders.select(
        k.alias("job_id"),
        F.concat(F.lit("user"), (c % 50).cast("string")).alias("username"),
        F.concat(F.lit("q"), (c % 9).cast("string")).alias("queue"),
        (k % 97).cast("string").alias("cups_job_id"),
        F.concat(F.lit("body-"), (c % 5).cast("string")).alias("content_sha256"),
        state.alias("state"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k % 86400)).alias("created_at"),
        F.concat(F.lit("reason "), (k % 13).cast("string")).alias("verdict_reason"),
        ((k * 37) % 347).alias("inline_ms"),
        F.when(c % 3 == 0, "text").when(c % 3 == 1, "ocr_complete").otherwise("ocr_pending").alias("scan_tier"),
        (k % 17 == 0).alias("purged"),
    )


HITS = """
hits AS (
  SELECT l_orderkey AS job_id, l_linenumber AS page, l_partkey % 16 AS rule_pos, 'rule-' || (l_partkey % 16) AS rule_id,
    'Rule ' || (l_partkey % 16) AS rule_name, (l_suppkey % 10)::INT AS severity,
    CASE l_suppkey % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'hold' WHEN 2 THEN 'hold' WHEN 3 THEN 'allow' ELSE 'log' END AS action,
    l_quantity::BIGINT AS count, 0.5::DOUBLE + l_discount * 5::DOUBLE AS score, '****' || l_linenumber AS sample,
    CASE WHEN l_linestatus = 'F' THEN 'text' ELSE 'ocr' END AS tier
  FROM lineitem)"""


def hits(t: Tables) -> DataFrame:
    pos, supp = F.col("l_partkey") % 16, F.col("l_suppkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page"), pos.alias("rule_pos"),
        F.concat(F.lit("rule-"), pos.cast("string")).alias("rule_id"),
        F.concat(F.lit("Rule "), pos.cast("string")).alias("rule_name"),
        (supp % 10).cast("int").alias("severity"),
        F.when(supp % 7 == 0, "block").when(supp % 7 <= 2, "hold").when(supp % 7 == 3, "allow").otherwise("log").alias("action"),
        F.col("l_quantity").cast("bigint").alias("count"),
        (F.lit(0.5) + F.col("l_discount") * 5.0).alias("score"),
        F.concat(F.lit("****"), F.col("l_linenumber").cast("string")).alias("sample"),
        F.when(F.col("l_linestatus") == "F", "text").otherwise("ocr").alias("tier"),
    )


CORPUS_MATCHES = """
matches AS (
  SELECT o_orderkey AS job_id, d AS document_id, 'Doc ' || d AS document_name, ((o_custkey + d) % 10)::INT AS severity,
    CASE (o_custkey + d) % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'log' ELSE 'hold' END AS action,
    (o_custkey % 40 + 1)::BIGINT AS overlap, (35 + (o_orderkey * d) % 66)::DOUBLE / 100::DOUBLE AS ratio
  FROM orders, (VALUES (1::BIGINT), (2), (3)) v(d) WHERE (o_orderkey + d) % 4 = 0)"""


def matches(t: Tables) -> DataFrame:
    d, k, c = F.col("d"), F.col("o_orderkey"), F.col("o_custkey")
    each = F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 3)])
    return t.orders.select("o_orderkey", "o_custkey", F.explode(each).alias("d")).filter((k + d) % 4 == 0).select(
        k.alias("job_id"), d.alias("document_id"), F.concat(F.lit("Doc "), d.cast("string")).alias("document_name"),
        ((c + d) % 10).cast("int").alias("severity"),
        F.when((c + d) % 5 == 0, "block").when((c + d) % 5 == 1, "log").otherwise("hold").alias("action"),
        (c % 40 + 1).alias("overlap"), ((F.lit(35) + (k * d) % 66).cast("double") / 100.0).alias("ratio"),
    )


# --- policies --------------------------------------------------------------------------

TAG_SETS = (["*"], ["pci", "secrets"], ["pii", "hr", "gdpr"], ["corporate"], [])

STORED_POLICIES = """
stored AS (
  SELECT queue, n % 2 = 0 AS deep_scan_required, CASE WHEN n % 3 = 0 THEN 'closed' ELSE 'open' END AS fail_mode,
    CASE n % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'log' WHEN 2 THEN 'block' ELSE 'allow' END AS on_unreadable,
    CASE n % 5 WHEN 0 THEN '*' WHEN 1 THEN 'pci,secrets' WHEN 2 THEN 'pii,hr,gdpr' WHEN 3 THEN 'corporate' ELSE '*' END AS tags
  FROM (SELECT DISTINCT source AS queue, substring(source, 4)::INT AS n FROM documents) WHERE n % 4 <> 3),
from_file AS (
  SELECT queue, CASE WHEN n % 8 = 3 THEN true ELSE false END AS deep_scan_required, 'closed' AS fail_mode, 'log' AS on_unreadable, 'secrets' AS tags
  FROM (SELECT DISTINCT source AS queue, substring(source, 4)::INT AS n FROM documents) WHERE n % 4 = 3 AND n < 12),
policies AS (
  SELECT d.queue,
    coalesce(s.deep_scan_required, f.deep_scan_required, false) AS deep_scan_required,
    coalesce(s.fail_mode, f.fail_mode, 'open') AS fail_mode,
    coalesce(s.on_unreadable, f.on_unreadable, 'log') AS on_unreadable,
    coalesce(s.tags, f.tags, '*') AS tags
  FROM (SELECT DISTINCT source AS queue FROM documents) d LEFT JOIN stored s USING (queue) LEFT JOIN from_file f USING (queue))"""


def queue_numbers(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("queue")).distinct().withColumn("n", F.substr("queue", F.lit(4)).cast("int"))


def stored_policies(t: Tables) -> DataFrame:
    n = F.col("n")
    tags = F.lit(None).cast("array<string>")
    for at, chosen in enumerate(TAG_SETS):
        tags = F.when(n % 5 == at, F.array(*[F.lit(x) for x in chosen]).cast("array<string>")).otherwise(tags)
    return queue_numbers(t).filter(n % 4 != 3).select(
        "queue", (n % 2 == 0).alias("deep_scan_required"),
        F.when(n % 3 == 0, "closed").otherwise("open").alias("fail_mode"),
        F.when(n % 4 == 0, "hold").when(n % 4 == 1, "log").when(n % 4 == 2, "block").otherwise("allow").alias("on_unreadable"),
        tags.alias("rule_tags"),
    )


def file_overrides(t: Tables) -> DataFrame:
    n = F.col("n")
    return queue_numbers(t).filter((n % 4 == 3) & (n < 12)).select(
        "queue", F.when(n % 8 == 3, True).alias("deep_scan_required"), F.lit("closed").alias("fail_mode"),
        F.lit(None).cast("string").alias("on_unreadable"), F.array(F.lit("secrets")).alias("rule_tags"),
    )


# --- corpus ----------------------------------------------------------------------------

CORPUS = """
corpus AS (
  SELECT item_id AS document_id, 'item-' || item_id AS name, (item_id % 10)::INT AS severity,
    CASE item_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'hold' ELSE 'log' END AS action, item_id % 13 <> 5 AS enabled, text
  FROM benchmark)"""


def corpus_source(t: Tables) -> DataFrame:
    i = F.col("item_id")
    return t.benchmark.select(
        i.alias("document_id"), F.concat(F.lit("item-"), i.cast("string")).alias("name"), F.lit("legal").alias("owner"),
        (i % 10).cast("int").alias("severity"),
        F.when(i % 3 == 0, "block").when(i % 3 == 1, "hold").otherwise("log").alias("action"), "text",
    )


def corpus(t: Tables):
    from veilscan.operators.fingerprint import register
    from veilscan.plans.inspect import Corpus

    registered, fingerprints = register(corpus_source(t))
    return Corpus(registered.withColumn("enabled", F.col("document_id") % 13 != 5), fingerprints)


WORDS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\pL\\pN_]+'), lambda w: w <> '')"


def fingerprint_ctes(source: str, key: str, name: str) -> str:
    """CTEs ``<name>_w/_s/_f``: words, shingle hashes and winnowed set of every text."""
    return f"""
{name}_w AS (SELECT {key}, {WORDS_SQL.format("text")} AS ws FROM {source}),
{name}_s AS (SELECT {key}, CASE WHEN len(ws) = 0 THEN []::BIGINT[] ELSE
    list_transform(range(1, greatest(len(ws) - 5, 0) + 2), lambda i: ('0x' || substring(md5(array_to_string(ws[i:i+4], ' ')), 1, 15))::BIGINT) END AS hs FROM {name}_w),
{name}_f AS (SELECT {key}, list_distinct(list_transform(range(1, greatest(len(hs) - 4, 0) + 2), lambda j: list_min(hs[j:j+3]))) AS fps FROM {name}_s WHERE len(hs) > 0)"""


OVERLAP_CTES = """
q AS (SELECT job_id, unnest(fps) AS h FROM d_f),
qn AS (SELECT job_id, len(fps) AS n FROM d_f),
c AS (SELECT document_id, unnest(fps) AS h FROM c_f),
cn AS (SELECT f.document_id, len(f.fps) AS n FROM c_f f JOIN corpus USING (document_id) WHERE enabled),
ovl AS (
  SELECT q.job_id, c.document_id, count(*) AS overlap FROM q JOIN c USING (h) JOIN cn USING (document_id) GROUP BY ALL),
found AS (
  SELECT o.job_id, o.document_id, k.name AS document_name, k.severity, k.action, o.overlap,
    least(1.0::DOUBLE, greatest(o.overlap::DOUBLE / qn.n, o.overlap::DOUBLE / cn.n)) AS ratio
  FROM ovl o JOIN qn USING (job_id) JOIN cn USING (document_id) JOIN corpus k USING (document_id)),
matches AS (SELECT * FROM found WHERE ratio >= 0.35::DOUBLE)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
