"""Personal data by weak supervision, as DataFrame operations only.

Candidates are found by regular expressions over whole texts: four base kinds (email, ip, card,
phone) and looser shapes (secrets, account numbers, dates, groups of digits, titled names).
Three labelers vote on every candidate, each for, against or not at all: its exact shape or
checksum, a gazetteer of prefixes, and words in the text before it. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is and how probable each
candidate; a logistic span classifier is trained on these probabilities with the shape of the
span as further features, and decides on every candidate that is not a valid base match.

Only matches leave the text, with 40 characters before them; the text itself is never shuffled.
Offsets are running sums over the gaps between matches. The driver sees counts of patterns: at
most kinds x 27 votes x 8 lengths x 5 digit shares.

Defined results: null text is empty; base matches that pass their check always stay; of added
spans those that overlap a base span or an added one before them are left out; rows that repeat
are repeated; null ids keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.tables import table, text_of, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "date", "digits", "name", "secret")

# Possessive forms of the base patterns: the same matches, in time linear in the text. A match
# starts with its run of characters, or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
TITLE = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)"
#: A capitalised word, after initials if any.
NAME = r"(?:\x20\p{Lu}\.){0,3}\x20\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:['’-]\p{L}++)*+"
LOOSE = "|".join((
    # Groups of four and what is left over; left over after a space it ends with a digit, unlike a word.
    r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}|\x20[A-Z0-9]{0,2}[0-9])?"
    r"|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{0,2}[0-9])(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
    r"(?<![0-9.+(-])\(?[0-9]{1,4}\)?(?:[\x20./-][0-9]{2,4}){2,3}(?![0-9])",
    rf"(?<![A-Za-z]){TITLE}\.?{NAME}(?:{NAME}){{0,5}}",
))
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Gazetteers: starts of card numbers, dialling codes, secrets and accounts; ends of host names.
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
DIAL_STARTS = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1-6]|9[0-58])"
SECRET_STARTS = "^(AKIA|ASIA|gh[pousr]_|sk-|pk_|xox|eyJ|AIza)"
ACCOUNT_STARTS = "^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE|SI|SK)"
HOST_ENDS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au)$"
#: Words before a candidate that speak for its kind, and those that speak against any.
FOR = {
    "email": "mail|contact|write|schreib|correo|courriel", "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta", "phone": "phone|call|tel|fax|mobil|ruf|appel|llam",
    "account": "iban|account|konto|compte|cuenta|bank", "date": "born|birth|dob|geboren|nacid|naissance",
    "digits": "ssn|social|security|passport|phone|tel|id", "name": "name|dear|by|from|signed",
    "secret": "token|secret|passw|key|auth|bearer|credential",
}
AGAINST = "version|isbn|chapter|section|page|figure|table|doi|article|licen[cs]e|release"


def found(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Array of (kind, i, gap, hit, before) of the matches in order; empty where ``guard`` is false."""
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"), F.lower(F.right(gap, F.lit(40))).alias("before")),
    )
    hits = F.transform(pairs, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["hit"].alias("hit"), p["before"].alias("before")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string,before:string>>")
    return F.when(guard, F.filter(hits, lambda p: p["hit"].isNotNull())).otherwise(none)


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, hits: one row per document."""
    text = text_of("text")
    guards = {k: text.contains(v) if len(v) == 1 else text.rlike(v) for k, v in NEEDS.items()}
    arrays = [found(text, PATTERNS[k], k, guards[k]) for k in BASE] + [found(text, LOOSE, "loose", F.lit(True))]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.concat(*arrays).alias("hits"))


def candidates(hits: DataFrame) -> DataFrame:
    """row, kind, start, end, base, hit, before: every match with its place; loose ones by shape."""
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = hits.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("size", F.length("hit").cast("long"))
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    hit, digits = F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    is_ = {k: F.col("kind") == k for k in BASE}
    base = (
        F.when(is_["email"], True)
        .when(is_["ip"], hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(is_["card"], F.length(digits).between(13, 19) & F.call_function("luhn_check", digits))
        .when(is_["phone"], F.length(digits).between(9, 15))
        .otherwise(False)
    )
    shape = (
        F.when(F.col("kind") != "loose", F.col("kind"))
        .when(hit.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]+$"), "account")
        .when(hit.rlike(rf"^{TITLE}\.?\x20"), "name")
        .when(hit.rlike(r"^[0-9]{1,4}[-/.][0-9]{2}[-/.][0-9]{2,4}$"), "date")
        .when(hit.rlike("[A-Za-z]"), "secret")
        .otherwise("digits")
    )
    return each.select("row", shape.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end", base.alias("base"),
                       "hit", "before")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(spans: DataFrame) -> DataFrame:
    """Adds the votes (shape, listed, context) and the features length and digit share."""
    hit, kind = F.col("hit"), F.col("kind")
    digits = F.regexp_replace("hit", "[^0-9]", "")
    is_ = {k: kind == k for k in (*BASE, *ADDED)}
    no = F.lit(False)
    shape = (
        F.when(kind.isin(*BASE), vote(F.col("base"), ~F.col("base")))
        .when(is_["secret"], vote(hit.rlike("^([0-9a-fA-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_=-]{20,})$"),
                                  hit.rlike("^[A-Za-z/-]+[0-9]{1,2}$")))
        .when(is_["account"], vote(F.length(F.regexp_replace("hit", " ", "")).between(15, 34), no))
        .when(is_["date"], vote(hit.rlike(r"^((19|20)[0-9]{2}[-/.](0[1-9]|1[0-2])[-/.][0-3][0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](19|20)[0-9]{2})$"), no))
        .when(is_["digits"], vote(hit.rlike(r"^([0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}|\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4})$"),
                                  F.length(digits) < 7))
        .otherwise(0)
    )
    listed = (
        F.when(is_["email"], vote(hit.rlike(HOST_ENDS), ~hit.rlike(HOST_ENDS)))
        .when(is_["ip"], vote(no, hit.rlike(r"^(0|127|2[3-5][0-9])\.")))
        .when(is_["card"], vote(digits.rlike(CARD_STARTS) & F.length(digits).between(13, 19), F.length(digits) < 13))
        .when(is_["phone"], vote(hit.rlike(DIAL_STARTS), no))
        .when(is_["secret"], vote(hit.rlike(SECRET_STARTS), no))
        .when(is_["account"], vote(hit.rlike(ACCOUNT_STARTS), ~hit.rlike(ACCOUNT_STARTS)))
        .when(is_["name"], F.lit(1))
        .otherwise(0)
    )
    cues = F.lit(0)
    for name, words in FOR.items():
        cues = F.when(kind == name, vote(F.col("before").rlike(words), F.col("before").rlike(AGAINST))).otherwise(cues)
    length = F.least(F.floor(F.length("hit") / 6), F.lit(7)).cast("int")
    share = F.floor(4 * F.length(digits) / F.length("hit")).cast("int")
    return spans.select("row", "kind", "start", "end", "base", shape.alias("shape"), listed.alias("listed"), cues.alias("context"),
                        length.alias("length"), share.alias("share"))


FEATURES = ("shape", "listed", "context", "length", "share")


def reliabilities(votes: np.ndarray, kinds: np.ndarray, n: np.ndarray, rounds: int = 40):
    """EM over vote patterns: (probability of each pattern, P(vote | private) tables labeler x class x vote).

    The classes start from the sum of votes, abstaining counting slightly against; priors are per kind, tables are shared by all kinds.
    """
    p = 1 / (1 + np.exp(1 - 2 * votes.sum(axis=1)))
    for _ in range(rounds):
        tables = np.zeros((votes.shape[1], 2, 3))
        for labeler in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, labeler] == v
                tables[labeler, :, v + 1] = (n[at] * (1 - p[at])).sum() + 1, (n[at] * p[at]).sum() + 1
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.zeros(len(n))
        for k in np.unique(kinds):
            at = kinds == k
            yes, no = (n[at] * p[at]).sum() + 1, (n[at] * (1 - p[at])).sum() + 1
            odds[at] = np.log(yes / no)
        for labeler in range(votes.shape[1]):
            odds += np.log(tables[labeler, 1, votes[:, labeler] + 1] / tables[labeler, 0, votes[:, labeler] + 1])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, tables


def classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the first is the bias."""
    x = np.column_stack((np.ones(len(x)), x))
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (q - p)) + ridge * w
        bend = (x * (share * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def trained(spans: DataFrame) -> Column:
    """Probability that a voted candidate is private, as a column over ``FEATURES`` and ``kind``."""
    rows = spans.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *FEATURES).collect()
    if not rows:
        return F.lit(0.0)
    names = [*BASE, *ADDED]
    kinds = np.array([names.index(r["kind"]) for r in rows])
    values = np.array([[r[f] for f in FEATURES] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    p, _ = reliabilities(values[:, :3], kinds, n)
    x = np.column_stack((values / np.array([1, 1, 1, 8, 4]), kinds[:, None] == np.arange(len(names))))
    w = classifier(x, p, n)
    score = F.lit(float(w[0]))
    for f, scale, weight in zip(FEATURES, (1, 1, 1, 8, 4), w[1:6]):
        score = score + F.lit(float(weight / scale)) * F.col(f)
    own = F.lit(0.0)
    for name, weight in zip(names, w[6:]):
        own = F.when(F.col("kind") == name, float(weight)).otherwise(own)
    return 1 / (1 + F.exp(-(score + own)))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<place, start, end, kind, base>> by kind and start: one row per document."""
    hits = written(matches(docs), "pii-hits")
    spans = written(voted(candidates(hits)), "pii-votes")
    likely = spans.withColumn("private", F.col("base") | (trained(spans) >= 0.5)).where("private")
    place = F.lit(0)
    for k, name in enumerate((*BASE, *ADDED)):
        place = F.when(F.col("kind") == name, k).otherwise(place)
    likely = likely.withColumn("place", place)
    # Base spans first at equal starts, so an added span there sees them among those before it.
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "place", "end")
    before, after = (order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing))
    overlaps = (F.coalesce(F.max("end").over(before) > F.col("start"), F.lit(False))
                | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    kept = likely.withColumn("overlaps", overlaps).where("base or not overlaps")
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "kind", "base"))).alias("spans"))
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    return hits.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir):
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return detected(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[number(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"))
