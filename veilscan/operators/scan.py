"""Pages x rules.

Every rule becomes one literal-pattern expression over the page text, so a pack costs one
scan of the pages and no join. All of a page's matches are found, checked, scored and
reduced inside its own row: there is no shuffle, and a page with very many matches stays
linear in its length. Raw matches never leave the expression; only masked samples do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.checks import check_named
from veilscan.functions.core import let, strip, unnest
from veilscan.functions.dialect import needed_literal, to_java, with_surroundings
from veilscan.sources.rules import Rule

HIT_COLUMNS = (
    "rule_id", "rule_name", "severity", "action", "count", "score", "sample", "contexts", "rule_pos",
)


def mask(value: Column, prefix: int, suffix: int) -> Column:
    """Keep the ends of a match and star the middle; star everything when it is too short."""
    return let(
        strip(value),
        lambda s: F.when(
            F.length(s) <= prefix + suffix, F.repeat(F.lit("*"), F.length(s))
        ).otherwise(
            F.concat(
                F.substr(s, F.lit(1), F.lit(prefix)),
                F.repeat(F.lit("*"), F.length(s) - (prefix + suffix)),
                F.substr(s, F.length(s) - (suffix - 1)) if suffix else F.lit(""),
            )
        ),
    )


def matches(text: Column, rule: Rule) -> Column:
    """Non-overlapping matches as array<struct<raw, near>>; ``near`` is the lower-cased text
    around a match, the match included."""
    java = to_java(rule.pattern, rule.ignore_case)
    if not rule.terms:
        return F.transform(
            F.regexp_extract_all(text, F.lit(java), F.lit(0)),
            lambda raw: F.struct(raw.alias("raw"), F.lit("").alias("near")),
        )
    wide = F.lit(with_surroundings(java, rule.window))
    before, raw, after = (F.regexp_extract_all(text, wide, F.lit(g)) for g in (1, 2, 3))
    return F.transform(
        F.arrays_zip(before.alias("b"), raw.alias("r"), after.alias("a")),
        lambda m: F.struct(
            m["r"].alias("raw"), F.lower(F.concat(m["b"], m["r"], m["a"])).alias("near")
        ),
    )


def base_score(rule: Rule) -> float:
    """Score before context, added in the fixed order on doubles."""
    return rule.base_confidence + (rule.validator_weight if rule.validator else 0.0)


def scored(found: Column, rule: Rule) -> Column:
    """Matches that pass the check, as array<struct<raw, terms, score>>; a match that lacks
    required context is gone, one below the threshold still carries its terms."""
    check = check_named(rule.validator)
    passing = F.filter(found, lambda m: check(m["raw"])) if rule.validator else found
    plain = min(base_score(rule), 1.0)
    if not rule.terms:
        with_terms = F.transform(
            passing,
            lambda m: F.struct(
                m["raw"].alias("raw"), F.array().cast("array<string>").alias("terms"),
                F.lit(plain).alias("score"),
            ),
        )
    else:
        lifted = min(base_score(rule) + rule.boost, 1.0)
        with_terms = F.transform(
            F.transform(
                passing,
                lambda m: F.struct(
                    m["raw"].alias("raw"),
                    F.array_compact(
                        F.array(
                            *[F.when(F.contains(m["near"], F.lit(t.lower())), F.lit(t)) for t in rule.terms]
                        )
                    ).alias("terms"),
                ),
            ),
            lambda m: F.struct(
                m["raw"].alias("raw"), m["terms"].alias("terms"),
                F.when(F.size(m["terms"]) > 0, F.lit(lifted)).otherwise(F.lit(plain)).alias("score"),
            ),
        )
    if rule.required:
        with_terms = F.filter(with_terms, lambda m: F.size(m["terms"]) > 0)
    return with_terms


def evaluate(text: Column, rule: Rule, position: int) -> Column:
    """The hit of one rule on one page as a struct, or null when it does not fire."""

    def reduce(ms: Column) -> Column:
        kept = F.filter(ms, lambda m: m["score"] >= F.lit(rule.threshold))
        return let(kept, lambda ks: hit(ms, ks))

    def hit(ms: Column, ks: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(ks, lambda m: m["score"])), F.lit(0.0))
        first_best = let(
            best, lambda b: F.get(F.filter(ks, lambda m: (m["score"] == b) & (b > 0.0)), F.lit(0))["raw"]
        )
        terms = F.array_sort(F.array_distinct(F.flatten(F.transform(ms, lambda m: m["terms"]))))
        return F.when(
            F.size(ks) >= rule.min_count,
            F.struct(
                F.lit(rule.id).alias("rule_id"),
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.action).alias("action"),
                F.size(ks).cast("bigint").alias("count"),
                F.greatest(best, F.lit(0.0)).alias("score"),
                F.coalesce(mask(first_best, rule.sample_prefix, rule.sample_suffix), F.lit("")).alias("sample"),
                terms.alias("contexts"),
                F.lit(position).alias("rule_pos"),
            ),
        )

    found = let(scored(matches(text, rule), rule), reduce)
    if rule.min_count <= 0:
        return found
    return F.when(may_match(text, rule), found)


def may_match(text: Column, rule: Rule) -> Column:
    """Whether a rule's pattern occurs in a text; cheapest test first, later ones only when
    the earlier ones hold."""
    test = F.rlike(text, F.lit(to_java(rule.pattern, rule.ignore_case, boundaries=False)))
    if "\\b" in rule.pattern.lower():
        test = test & F.rlike(text, F.lit(to_java(rule.pattern, rule.ignore_case)))
    literal = needed_literal(rule.pattern, rule.ignore_case)
    return F.contains(text, F.lit(literal)) & test if literal else test


def hits_of(
    text: Column, rules: Sequence[Rule], scope: Callable[[Rule], Column] | None = None
) -> Column:
    """array<struct> of all hits of a pack on a page. ``scope`` is a cheap row condition that
    must hold before a rule's pattern is tried at all. Blank pages have none."""
    if not rules:
        raise ValueError("no rules to evaluate")
    parts = []
    for position, rule in enumerate(rules):
        hit = evaluate(text, rule, position)
        if scope is not None:
            hit = F.when(scope(rule), hit)
        parts.append(hit)
    return F.when(strip(text) != "", F.array_compact(F.array(*parts)))


def in_scope(rule: Rule, tags: Column) -> Column:
    """Tag scoping: ``*`` keeps every rule, else one tag has to be shared."""
    wanted = F.array_contains(tags, "*")
    if rule.tags:
        wanted = wanted | F.arrays_overlap(tags, F.array(*[F.lit(t) for t in rule.tags]))
    return wanted


@lru_cache(maxsize=64)
def pack_expression(rules: tuple[Rule, ...], tags: str | None, only: str | None, jvm: int) -> Column:
    """The expression of a whole pack; built once per pack, as building it costs more than
    planning it. ``jvm`` keeps expressions of different sessions apart."""
    scope = None
    if tags:
        scope = lambda rule: in_scope(rule, F.col(tags))
    elif only:
        scope = lambda rule: F.col(only) == F.lit(rule.id)
    return hits_of(F.col("text"), rules, scope)


def page_hits(
    pages: DataFrame, rules: Sequence[Rule], tags: str | None = None, only: str | None = None
) -> Column:
    """All hits of a page as one array column of ``pages``."""
    pack = tuple(sorted(rules, key=lambda r: r.id))
    return pack_expression(pack, tags, only, id(pages.sparkSession.sparkContext._jvm))


def scan_pages(
    pages: DataFrame,
    rules: Sequence[Rule],
    tags: str | None = None,
    only: str | None = None,
    tier: str = "text",
    keep: Sequence[str] = ("job_id", "page"),
) -> DataFrame:
    """Hits of ``pages(job_id, page, text)``: one row per page and firing rule.

    ``tags`` names a column with the tags a page is scanned for, ``only`` a column with the
    one rule id to try. Both are decided per row before any pattern runs.
    """
    return hit_rows(pages, page_hits(pages, rules, tags, only), tier, keep)


def hit_rows(pages: DataFrame, found: Column, tier: str = "text", keep: Sequence[str] = ("job_id", "page")) -> DataFrame:
    """One row per hit of an array of them."""
    return unnest(pages, found, "hit", keep).select(*keep, *[F.col(f"hit.{c}") for c in HIT_COLUMNS], F.lit(tier).alias("tier"))
