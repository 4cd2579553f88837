import json
import random

import pytest
from pyspark.sql import functions as F

import model
from veilscan.operators import rule_admin as ra
from veilscan.operators.scan import mask, scan_pages
from veilscan.sources.rules import (
    Rule, RuleError, active, duplicate_ids, load_rules, nested, rule_from, rules_from_table, rules_table, shipped_rules,
)


def found(pages_df, rules, **options):
    return {(r.job_id, r.rule_id): r for r in scan_pages(pages_df, rules, **options).collect()}


def test_shipped_pack_meets_its_fixtures(spark):
    table = rules_table(spark, shipped_rules())
    fixtures = ra.fixture_rows(table)
    assert fixtures.count() >= 40
    assert ra.fixture_failures(fixtures, shipped_rules()).collect() == []


def test_fixture_failures_name_both_kinds_and_gate_rules(spark):
    good = Rule("good", "g", "abc", base_confidence=0.9, positive=("xabc",), negative=("ab",))
    bad = Rule("bad", "b", "abc", base_confidence=0.9, positive=("nothing",), negative=("abc",))
    off = Rule("off", "o", "abc", enabled=False, positive=("nothing",))
    table = rules_table(spark, [good, bad, off])
    failures = ra.fixture_failures(ra.fixture_rows(table), [good, bad])
    assert {(r.rule_id, r.kind) for r in failures.collect()} >= {("bad", "false-negative"), ("bad", "false-positive")}
    assert [r.id for r in ra.passing_rules(table, failures).collect()] == ["good"]


RANDOM_RULES = [
    Rule("r0", "plain", r"ab+", base_confidence=0.8),
    Rule("r1", "context", r"\bcar\b", base_confidence=0.5, threshold=0.7, terms=("bus", "Ti"), window=6, boost=0.25),
    Rule("r2", "required", r"x[0-9]{2,}", base_confidence=0.9, terms=("é", "key"), window=4, required=True, min_count=2),
    Rule("r3", "case", r"[A-Z]{2}", ignore_case=False, base_confidence=0.76, sample_prefix=1, sample_suffix=0),
    Rule("r4", "groups", r"(a|b)(c)?d", base_confidence=0.5, threshold=0.6, terms=("z",), window=0, boost=0.3),
    Rule("r5", "many", r"\s", base_confidence=0.75, min_count=5, terms=("bus",), window=3),
]


def test_random_texts_match_the_plain_model(pages):
    rng = random.Random(5)
    parts = ["ab", "abb", "car", "CAR", "bus", "ti", "x12", "x3", "é", "key", "AB", "ad", "bcd", "z", " ", "  ", "\n", ".", "é1", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    hits = found(pages(*texts), RANDOM_RULES)
    for n, text in enumerate(texts):
        for rule in RANDOM_RULES:
            expected = model.scan_page(rule, text) if text.strip() else None
            got = hits.get((n, rule.id))
            assert (got is None) == (expected is None), (text, rule.id)
            if got:
                assert (got["count"], got.score, got["sample"], got.contexts) == expected, (text, rule.id)


def test_context_window_edges_include_the_match(pages):
    rule = Rule("w", "w", r"#\d+", base_confidence=0.8, terms=("key", "7"), window=3, required=True)
    hits = found(pages("key#1", "key.#1", "keys  #1", "#7", "#1key", "#1 ..key"), [rule])
    assert sorted(job for job, _ in hits) == [0, 3, 4]


def test_boost_reaches_an_exact_threshold(pages):
    rule = Rule("d", "d", "bonus", base_confidence=0.4, threshold=0.65, terms=("band",), boost=0.25)
    assert len(found(pages("bonus band", "bonus"), [rule])) == 1


def test_minimum_is_counted_per_page_and_zero_always_fires(spark):
    df = spark.createDataFrame([(1, 1, "k k"), (1, 2, "k"), (2, 1, "none"), (3, 1, " \n")], "job_id int, page int, text string")
    two = Rule("two", "t", "k", base_confidence=0.9, min_count=2)
    always = Rule("zero", "z", "q", base_confidence=0.9, min_count=0)
    got = {(r.job_id, r.page, r.rule_id, r["count"]) for r in scan_pages(df, [two, always]).collect()}
    assert got == {(1, 1, "two", 2), (1, 1, "zero", 0), (1, 2, "zero", 0), (2, 1, "zero", 0)}


def test_tags_scope_rules_per_row(spark):
    rules = [Rule("a", "a", "x", base_confidence=0.9, tags=("pii",)), Rule("b", "b", "x", base_confidence=0.9)]
    df = spark.createDataFrame(
        [(1, 1, "x", ["*"]), (2, 1, "x", ["pii", "hr"]), (3, 1, "x", ["hr"])], "job_id int, page int, text string, tags array<string>"
    )
    assert set(found(df, rules, tags="tags")) == {(1, "a"), (1, "b"), (2, "a")}


def test_hits_hold_no_raw_text(pages):
    columns = scan_pages(pages("4111"), shipped_rules()).columns
    assert "raw" not in columns and "text" not in columns


@pytest.mark.parametrize("value,prefix,suffix,expected", [
    ("4111111111111111", 4, 4, "4111********1111"), ("  short ", 4, 4, "*****"), ("12345678", 4, 4, "********"),
    ("123456789", 4, 4, "1234*6789"), ("abcdef", 0, 2, "****ef"), ("abcdef", 2, 0, "ab****"), ("", 4, 4, ""),
])
def test_mask(spark, value, prefix, suffix, expected):
    assert spark.range(1).select(mask(F.lit(value), prefix, suffix)).first()[0] == expected


def test_a_page_with_very_many_matches_stays_linear(pages):
    text = "u@example.org " * 60_000
    rule = Rule("e", "e", r"\b\w+@[a-z.]+\b", base_confidence=0.9, terms=("org",), window=50)
    assert found(pages(text), [rule])[(0, "e")]["count"] == 60_000


def test_rule_files(tmp_path):
    (tmp_path / "b.yaml").write_text("rules:\n  - {id: z, name: Z, pattern: z}\n  - {id: off, name: O, pattern: o, enabled: false}\n")
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a", "name": "A", "pattern": "a", "context": {"terms": ["t"], "window": 9}}]))
    rules = load_rules(str(tmp_path))
    assert [r.id for r in rules] == ["a", "z"] and rules[0].window == 9 and rules[0].boost == 0.3
    (tmp_path / "c.yaml").write_text("rules: [{id: z, name: Z, pattern: z}]")
    with pytest.raises(RuleError, match="duplicate"):
        load_rules(str(tmp_path))
    (tmp_path / "c.yaml").write_text("rules: [{id: y, name: Y, pattern: '('}]")
    with pytest.raises(RuleError, match="c.yaml"):
        load_rules(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        load_rules(str(tmp_path / "none"))


@pytest.mark.parametrize("part,fault", [
    ({"severity": 11}, "severity"), ({"validator": "nosuch"}, "unknown check"), ({"action": "burn"}, "action"), ({"nosuch": 1}, None),
])
def test_bad_rules_are_refused(part, fault):
    entry = {"id": "r", "name": "R", "pattern": "x"} | part
    if fault is None:
        assert rule_from(entry).id == "r"
    else:
        with pytest.raises(RuleError, match=fault):
            rule_from(entry)


def test_rules_survive_the_table_and_duplicates_show(spark):
    rules = shipped_rules()
    table = rules_table(spark, rules)
    assert [nested(r) for r in rules_from_table(table)] == [nested(r) for r in rules]
    assert duplicate_ids(table).count() == 0
    assert duplicate_ids(table.union(table.filter("id = 'iban'"))).first().id == "iban"
    with pytest.raises(RuleError):
        active([rules[0], rules[0]])


@pytest.mark.parametrize("pattern,text", [("(?i)secret", "my SECRET here"), (r"\x41\d+", "A77"), (r"\pL+", "one two")])
def test_escapes_and_flags_are_no_literals(spark, pattern, text):
    from veilscan.functions.dialect import needed_literal, to_java

    literal = needed_literal(pattern, False)
    assert literal in text
    assert spark.range(1).select(F.rlike(F.lit(text), F.lit(to_java(pattern, False)))).first()[0]


@pytest.mark.parametrize("pattern", ["confidential", "conf[a-z]dential", "(?:strictly |)confidential"])
def test_other_letters_i_do_not_fold(spark, pattern):
    from veilscan.functions.dialect import to_java

    java = F.lit(to_java(pattern))
    texts = ["confidential", "CONFIDENTIAL", "confıdential", "confİdential"]
    assert list(spark.range(1).select(*[F.rlike(F.lit(t), java).alias(str(k)) for k, t in enumerate(texts)]).first()) == [True, True, False, False]
