"""SQL form of the rule scan, generated from the same pack."""

from __future__ import annotations

from collections.abc import Sequence

from veilscan.catalog.derived import strip_sql
from veilscan.sources.rules import Rule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def luhn(value: str) -> str:
    d = digits(value)
    return (
        f"(length({d}) >= 12 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 0 THEN (2 * reverse({d})[i]::INT) // 10 + (2 * reverse({d})[i]::INT) % 10 ELSE reverse({d})[i]::INT END)) % 10 = 0)"
    )


def iban(value: str) -> str:
    c = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', '', 'g'))"
    r = f"({c}[5:] || {c}[1:4])"
    return (
        f"(length({c}) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(1, length({c}) + 1), lambda i: ascii({r}[i])::BIGINT), "
        f"lambda a, x: CASE WHEN x >= 65 THEN (a * 100 + x - 55) % 97 ELSE (a * 10 + x - 48) % 97 END, 0::BIGINT) = 1)"
    )


def us_ssn(value: str) -> str:
    d = digits(value)
    return (
        f"(length({d}) = 9 AND {d}[1:3] NOT IN ('000', '666') AND {d}[1:1] <> '9' AND {d}[4:5] <> '00' AND {d}[6:9] <> '0000'"
        f" AND {d} NOT IN ('123456789', '111111111', '000000000'))"
    )


def nhs_number(value: str) -> str:
    d = digits(value)
    total = f"list_sum(list_transform(range(1, 10), lambda i: {d}[i]::INT * (11 - i)))"
    check = f"(11 - {total} % 11)"
    return (
        f"CASE WHEN length({d}) <> 10 THEN false WHEN {check} = 10 THEN false "
        f"ELSE (CASE WHEN {check} = 11 THEN 0 ELSE {check} END) = {d}[10]::INT END"
    )


def mod11(value: str) -> str:
    d = digits(value)
    total = f"list_sum(list_transform(range(1, length({d})), lambda i: {d}[length({d}) - i]::INT * ((i - 1) % 6 + 2)))"
    check = f"(11 - {total} % 11)"
    return (
        f"CASE WHEN length({d}) < 8 THEN false ELSE (CASE WHEN {check} >= 10 THEN 0 ELSE {check} END) = {d}[length({d})]::INT END"
    )


def entropy(value: str) -> str:
    s = strip_sql(value)
    bits = (
        f"-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: "
        f"(len(list_filter(string_split({s}, ''), lambda x: x = c))::DOUBLE / length({s})) * log2(len(list_filter(string_split({s}, ''), lambda x: x = c))::DOUBLE / length({s}))))"
    )
    return f"CASE WHEN length({s}) < 16 THEN false ELSE round({bits}, 12) >= 3.0 END"


CHECK_SQL = {
    "luhn": luhn, "iban": iban, "us_ssn": us_ssn, "nhs_number": nhs_number, "mod11": mod11, "entropy": entropy,
    "none": lambda v: "true", "always": lambda v: "true",
}


def mask(value: str, prefix: int, suffix: int) -> str:
    s = strip_sql(value)
    return (
        f"CASE WHEN length({s}) <= {prefix + suffix} THEN repeat('*', length({s})) "
        f"ELSE left({s}, {prefix}) || repeat('*', length({s}) - {prefix + suffix}) || right({s}, {suffix}) END"
    )


def rule_sql(rule: Rule, position: int, source: str, tags: str | None) -> str:
    pattern = quoted(("(?i)" if rule.ignore_case else "") + rule.pattern)
    plain = f"{rule.base_confidence}::DOUBLE" + (f" + {rule.validator_weight}::DOUBLE" if rule.validator else "")
    terms = "[" + ", ".join(quoted(t) for t in rule.terms) + "]::VARCHAR[]"
    scope = "true"
    if tags:
        listed = f"string_split({tags}, ',')"
        scope = f"(list_contains({listed}, '*') OR list_has_any({listed}, [{', '.join(quoted(t) for t in rule.tags)}]))"
    check = CHECK_SQL[rule.validator]("raw") if rule.validator else "true"
    return f"""
SELECT job_id, page, {quoted(rule.id)} AS rule_id, {quoted(rule.name)} AS rule_name, {rule.severity} AS severity,
  {quoted(rule.action)} AS action, {position} AS rule_pos, count(*) FILTER (ok) AS count, max(score) FILTER (ok) AS score,
  first(masked ORDER BY score DESC, i) FILTER (ok) AS sample,
  array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS contexts
FROM (
  SELECT *, score >= {rule.threshold}::DOUBLE AS ok FROM (
    SELECT job_id, page, i, raw, terms, {mask("raw", rule.sample_prefix, rule.sample_suffix)} AS masked,
      least(1.0::DOUBLE, CASE WHEN len(terms) > 0 THEN {plain} + {rule.boost}::DOUBLE ELSE {plain} END) AS score
    FROM (
      SELECT job_id, page, i, raw, list_filter({terms}, lambda t: contains(near, lower(t))) AS terms FROM (
        SELECT job_id, page, i, ms[i] AS raw,
          lower(substring(text, (greatest(0, place - {rule.window}) + 1)::BIGINT, (place + length(ms[i]) + {rule.window} - greatest(0, place - {rule.window}))::BIGINT)) AS near
        FROM (
          SELECT job_id, page, text, ms, i,
            coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS place
          FROM (SELECT job_id, page, text, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT job_id, page, text, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps
            FROM {source} WHERE regexp_matches(text, {pattern}) AND {scope} AND {strip_sql("text")} <> ''))))
      WHERE {check})
    WHERE {"len(terms) > 0" if rule.required else "true"}))
GROUP BY job_id, page HAVING count(*) FILTER (ok) >= {rule.min_count}"""


def scan_cte(name: str, rules: Sequence[Rule], source: str, tags: str | None = None) -> str:
    ordered = sorted(rules, key=lambda r: r.id)
    return f"{name} AS (" + " UNION ALL ".join(rule_sql(r, i, source, tags) for i, r in enumerate(ordered)) + ")"
