import pytest
from pyspark.sql import functions as F

from veilscan.functions import cef, checks
from veilscan.functions import text as tx
from veilscan.functions.dialect import PatternError, first_letters, needed_literal, problems, to_java
from veilscan.functions.policy import expand_mode, mode_of
from veilscan.operators import lifecycle as lc
from veilscan.operators.fingerprint import overlap_label


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name,raw,expected", [
    ("luhn", "4012-8888 8888 1881", True), ("luhn", "4012888888881882", False), ("luhn", "00000000000", False), ("luhn", "000000000000", True),
    ("iban", "FR14 2004 1010 0505 0001 3M02 606", True), ("iban", "GB82west12345698765432", True), ("iban", "GB83WEST12345698765432", False),
    ("iban", "XX00", False), ("iban", "A" * 35, False),
    ("us_ssn", "219-09-9999", True), ("us_ssn", "666-09-9999", False), ("us_ssn", "900-09-9999", False), ("us_ssn", "219-00-9999", False),
    ("us_ssn", "219-09-0000", False), ("us_ssn", "123-45-6789", False), ("us_ssn", "21909999", False),
    ("nhs_number", "401 023 2137", True), ("nhs_number", "4010232138", False), ("nhs_number", "401023213", False),
    ("mod11", "12345670", False), ("mod11", "1234567", False), ("mod11", "00000000", True),
    ("entropy", "abcdefghabcdefgh", True), ("entropy", "abcdefgabcdefga", False), ("entropy", "aaaaaaaaaaaaaaaaaaaa", False),
    ("none", "", True), ("always", "x", True), (None, "x", True),
])
def test_checks(spark, name, raw, expected):
    assert value(spark, checks.check_named(name)(F.lit(raw))) is expected


def test_unknown_check_and_own_check(spark):
    with pytest.raises(checks.UnknownCheck):
        checks.check_named("nosuch")
    checks.register_check("even", lambda v: F.length(v) % 2 == 0)
    try:
        assert value(spark, checks.check_named("even")(F.lit("ab")))
        assert value(spark, checks.dispatch(F.lit("even"), F.lit("abc"))) is False
    finally:
        del checks.CHECKS["even"]


def test_pandas_check_has_the_same_shape(spark):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def starts_with_a(v):
        return v.str.startswith("a")

    checks.register_check("starts-a", starts_with_a)
    try:
        df = spark.createDataFrame([("ab",), ("ba",)], "v string")
        got = df.select(checks.check_named("starts-a")(F.col("v")).alias("ok")).collect()
        assert [r.ok for r in got] == [True, False]
    finally:
        del checks.CHECKS["starts-a"]


@pytest.mark.parametrize("pattern,ignore,text,expected", [
    (r"\b\d{2}\b", True, "é12 x12 12é 12", ["12", "12", "12"]),
    (r"secret", True, "\u017fecret SECRET", ["\u017fecret", "SECRET"]),
    (r"k", True, "\u212a", ["\u212a"]), (r"secret", False, "SECRET", []),
    (r"a\sb", True, "a\x0bb a b", ["a b"]), (r"\S+", True, "a\x0bb c", ["a\x0bb", "c"]),
    (r"x$", True, "x\nx\n", []), (r"x$", True, "x\nx", ["x"]), (r"(?m)x$", True, "x\nx", ["x", "x"]),
    (r"a.c", True, "a\rc a\nc", ["a\rc"]), (r"[[:digit:]]+", True, "a12", ["12"]), (r"[^[:alpha:]]", True, "a1", ["1"]),
    (r"[a[]+", True, "a[b", ["a["]), (r"[a&&b]+", True, "a&b", ["a&b"]), (r"[\s,]+", True, "a, b", [", "]), (r"\Bb", True, "ab b éb", ["b"]),
])
def test_dialect(spark, pattern, ignore, text, expected):
    assert value(spark, F.regexp_extract_all(F.lit(text), F.lit(to_java(pattern, ignore)), F.lit(0))) == expected


@pytest.mark.parametrize("pattern", [r"foo(?=bar)", r"foo(?!bar)", r"(?<=a)b", r"(?<!a)b", r"(\w+)\s+\1", r"a++", r"(a+)+$", r"(", r"(?>a)"])
def test_refused_patterns(pattern):
    assert problems(pattern)
    with pytest.raises(PatternError):
        to_java(pattern)


def test_text_evident_in_a_pattern():
    assert needed_literal(r"\w+@\w+", True) == "@" and needed_literal(r"ab?cd", False) == "cd"
    assert needed_literal("a|b", False) == "" and needed_literal(r"x{2}yz", False) == "yz"
    assert first_letters(r"\b(?:salary|bonus)\b", False) == "bs" and "\u017f" in first_letters("(?:s|t)x", True)
    assert first_letters("(?:a|b)?c") == "" and first_letters("a|b") == "" and first_letters("[ab]") == ""


SOUP = "!\"#$%&'(#)*$+'+,+-.*!+--/#\"$0*1%)'.\"23&#"


@pytest.mark.parametrize("text,language,thin", [
    ("production database and other words", True, False), ("FULLY SECRET NOTES", True, True), (SOUP, False, True), ("", False, True), ("  \n\t", False, True),
    ("Rechnung 4111 total 1,204.55 due in 30 days", True, False), ("ab cd ef gh ij kl mn op qr", True, False), ("bcd fgh jkl 123456789012345678901234567890", False, True),
    ("\u00a0" * 30, False, True), ("éàü éàü éàü éàü éàü éàü", True, False),
])
def test_plausibility(spark, text, language, thin):
    assert value(spark, tx.looks_like_language(F.lit(text))) is language
    assert value(spark, tx.is_thin(F.lit(text))) is thin
    assert value(spark, tx.is_misencoded(F.lit(text))) is (not language and len(text.strip()) >= 20)


@pytest.mark.parametrize("body,expected", [
    (b"%PDF-1.4", "pdf"), (b"junk" * 9 + b"%PDF", "pdf"), (b"x" * 1021 + b"%PDF", "pdf"), (b"%!PS", "postscript"), (b"\x1b%-12345X@PJL", "pcl"),
    (b"\x1bE", "pcl"), (b"a\x00b", "binary"), (b"\xff\xfe", "binary"), (b"a" * 1023 + "é".encode(), "text"), (b"a" * 2000 + b"\x00", "binary"), (b"a" * 2000 + b"\xff", "binary"), (b"a" * 1022 + "é".encode(), "text"), (b"", "text"),
])
def test_formats(spark, body, expected):
    assert value(spark, tx.sniff_format(F.lit(body))) == expected


def test_magic_line(spark):
    assert value(spark, tx.magic(F.lit(b"RaS2\x00\xffpqr"))) == " first bytes: 52 61 53 32 00 ff 70 71 72 |RaS2..pqr|"
    assert value(spark, tx.magic(F.lit(b""))) == ""


@pytest.mark.parametrize("options,expected", [
    ("copies=1 job-originating-host-name=WS-9.corp x=1", "WS-9.corp"), ("job-originating-host-name='WS-9'", "WS-9"), ("a=1", ""), ("", ""), (None, ""),
    ("xjob-originating-host-name=no", ""), ('job-originating-host-name="10.0.0.7"', "10.0.0.7"),
])
def test_originating_host(spark, options, expected):
    assert value(spark, lc.originating_host(F.lit(options).cast("string"))) == expected


def test_alert_escaping_and_severity(spark):
    assert value(spark, cef.escape_header(F.lit("a|b\\c"))) == "a\\|b\\\\c"
    assert value(spark, cef.escape_extension(F.lit("a=b\\c\nd\re"))) == "a\\=b\\\\c d e"
    assert value(spark, cef.extensions({"a": F.lit("1"), "b": F.lit(""), "c": F.lit(None).cast("string"), "d": F.lit("x=y")})) == "a=1 d=x\\=y"
    assert value(spark, cef.header(F.lit("S"), F.lit("N"), F.lit(99))).endswith("|S|N|10")
    for state, top, severity in (("failed_open", 9, 7), ("blocked", 3, 8), ("blocked", 9, 9), ("held", None, 6), ("released_then_flagged", 2, 7)):
        kind = cef.event_kind(F.lit(state), F.lit(True))
        assert value(spark, cef.event_severity(kind, F.lit(top).cast("int"))) == severity
    assert value(spark, cef.event_severity(cef.event_kind(F.lit("released"), F.lit(True)), F.lit(4))) == 4
    assert value(spark, cef.event_severity(cef.event_kind(F.lit("released"), F.lit(False)), F.lit(None).cast("int"))) == 1


def test_rounding_and_modes(spark):
    assert value(spark, overlap_label(F.lit(0.625))) == "62% overlap"
    assert value(spark, mode_of(F.lit(True), F.lit("hold"))) == "enforce" and value(spark, mode_of(F.lit(True), F.lit("log"))) == "custom"
    assert value(spark, expand_mode(F.lit("enforce"), "on_unreadable", F.lit("block"))) == "block"
    assert value(spark, expand_mode(F.lit("monitor"), "deep_scan_required", F.lit(None))) is False
    assert value(spark, lc.oversize(F.lit(11), F.lit("closed"), 10)) == "hold" and value(spark, lc.oversize(F.lit(10), F.lit("closed"), 10)) is None


def re2_matches(pattern, text):
    """What an engine of the dialect itself finds."""
    import duckdb

    return duckdb.execute("SELECT regexp_extract_all(?, " + "'" + pattern.replace("'", "''") + "')", [text]).fetchall()[0][0]


I_TEXT = "confidential CONFIDENTIAL conf\u0131dential CONF\u0130DENTIAL in \u0131n \u0130N xn 4n a.b A.B aab aaab\nline end\nbob"


@pytest.mark.parametrize("pattern,ignore", [
    ("confidential", True), ("(?i)confidential", False), (r"conf\x69dential", True), ("(?P<n>confidential)", True), ("[^i]n", True), ("[g-k]n", True),
    ("[^g-k]n", True), ("\u0131n", True), (r"\Qa.b\E", True), (r"(?U)a+b", False), ("a+?b", False), ("(?U)a+?b", False), ("a(?i)A", False), ("(?m)^\\w+$", False),
    ("(?m:^line) end$|b$", False), (r"\x{61}{2}", False), ("(?i:I)n", False), ("(?-i:i)n", True),
])
def test_flags_codes_and_the_other_i(spark, pattern, ignore):
    got = value(spark, F.regexp_extract_all(F.lit(I_TEXT), F.lit(to_java(pattern, ignore)), F.lit(0)))
    assert got == re2_matches(("(?i)" if ignore else "") + pattern, I_TEXT)


@pytest.mark.parametrize("pattern", ["(?:a|aa)+$", "((?:a+))+$", r"(\w+\s?)*$", "(a|b|ab)*c", "(a*)*b", "(a?a?)*b", "(.*,)*x", "(x+x+)+y"])
def test_exponential_patterns_are_refused(pattern):
    assert "exponential" in problems(pattern)[0]


@pytest.mark.parametrize("pattern", ["(?:a|b)*c", r"(?:[a-z]{1,9}, ?)*end", r"(?:\d{4}[ -]?){3}\d{4}", "(ab*c)*d", r"\b(?:[A-Z]+, )*[A-Z]+\b"])
def test_harmless_repeats_pass(pattern):
    assert problems(pattern) == []


def test_a_rule_java_cannot_compile_is_refused_on_loading(spark):
    from veilscan.sources.rules import RuleError, java_fault, rule_from

    assert java_fault("(?<a_b>x)") and java_fault("x") is None
    with pytest.raises(RuleError):
        rule_from({"id": "x", "name": "n", "pattern": r"\p{NoSuchScript}+"})
