"""Mixing sources to target weights by hierarchical budgets.

Documents are the leaves' stock in a tree domain - language - source. A token budget goes down
the tree by the weights of siblings. A child can take no more than its subtree can supply (its
tokens times the permitted epochs); what it cannot take goes to its siblings by their weights,
and only what a whole subtree cannot take goes to the siblings of its parent. Each leaf then
takes whole epochs of its stock and a token-prefix of one further epoch, whose order is a seeded
hash of the documents' ids.

The level of the filling ("water level") of siblings has a closed form over siblings sorted by
supply per weight, so one window per level of the leaf table is enough. A leaf's prefix is found
by token totals of hash ranges first and then inside the one range where the quota ends, so a
leaf that holds a third of all rows is never put in order in one task.

Defined results: null text has no tokens; null domain, language or source is a value of its own;
a document enters a prefix only whole, so a leaf stays below its quota by less than one document;
rows with equal id and leaf are taken together or not at all; a leaf without tokens takes
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.tables import free_name, set_aside, table, text_of, written

LEVELS = ("domain", "lang_leaf", "source_leaf")
RANGES = 4096


def tokens_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60-bit place of a document in an epoch, from MD5 so that any engine can repeat it."""
    named = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def filled(nodes: DataFrame, parent: list[str], node: str, budget: str, quota: str) -> DataFrame:
    """Adds ``quota``: ``budget`` of the parent over its children by ``weight``, none above ``supply``.

    With siblings sorted by supply per weight, the first ones get their whole supply; from the
    first that does not need all of its share on, what is left goes by weight. Whole tokens,
    rounded down. Siblings of weight 0 come last and get nothing.
    """
    family = Window.partitionBy(*parent)
    in_order = family.orderBy("ratio", node)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(budget) - F.coalesce(F.sum("supply").over(before), F.lit(0))
    weight_left = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(1e300))
        .withColumn("level", F.when(weight_left > 0, left / F.when(weight_left > 0, weight_left)))
        .withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(family))
        .withColumn(
            quota,
            F.when(F.col("weight") <= 0, 0.0)
            .when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("supply").cast("double"))
            .otherwise(F.floor(F.col("level") * F.col("weight") + F.lit(1e-6)))
            .cast("long"),
        )
        .drop("ratio", "level")
    )


def budgets(leaves: DataFrame, budget: int, epochs: int, weights: dict[str, Column]) -> DataFrame:
    """Leaves with quotas. ``weights``: a whole-number column for each level, over that level's names."""
    stock = leaves.withColumn("supply", F.col("tokens") * epochs)
    top = stock.groupBy("domain").agg(F.sum("supply").alias("supply"))
    top = top.withColumn("weight", weights["domain"]).withColumn("all", F.lit(0)).withColumn("budget", F.lit(budget))
    top = filled(top, ["all"], "domain", "budget", "domain_quota").select("domain", "domain_quota")
    middle = stock.groupBy("domain", "lang_leaf").agg(F.sum("supply").alias("supply")).join(top, "domain")
    middle = filled(middle.withColumn("weight", weights["lang"]), ["domain"], "lang_leaf", "domain_quota", "lang_quota")
    middle = middle.select("domain", "lang_leaf", "lang_quota")
    last = stock.join(middle, ["domain", "lang_leaf"]).withColumn("weight", weights["source"])
    return filled(last, ["domain", "lang_leaf"], "source_leaf", "lang_quota", "quota").select(*LEVELS, "tokens", "quota")


def plan(docs: DataFrame, share: float, epochs: int, weights: dict[str, Column], seed: int) -> DataFrame:
    """One row per leaf: tokens, quota, whole epochs, and the last key of the prefix.

    ``docs`` has the tree's columns, doc_id and n_tokens.
    """
    leaves = written(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = (
        budgets(leaves, int(total * share), epochs, weights)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0))
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    )
    quotas = written(quotas, "quotas")
    keyed = docs.join(quotas.select(*LEVELS, "whole", "rest"), list(LEVELS)).select(
        *LEVELS, "rest", "n_tokens", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key")
    ).withColumn("range", F.shiftright("key", 48))
    ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    edge = (
        ranges.withColumn("upto", F.sum("n").over(upto))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        .select(*LEVELS, "range", (F.col("upto") - F.col("n")).alias("before"))
    )
    inside = keyed.join(edge, [*LEVELS, "range"])
    # A range frame: rows of one key count together.
    sums = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
    last = (
        inside.withColumn("sum", F.col("before") + sums)
        .groupBy(*LEVELS)
        .agg(F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("key"))),
                        F.shiftleft(F.min("range"), 48) - 1).alias("last_key"))
    )
    return quotas.join(last, list(LEVELS), "left").withColumn("last_key", F.coalesce("last_key", F.lit(-1)))


def domain_of(source: Column) -> Column:
    """Four domains by the number in a source's name; other names are a domain of their own."""
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as bigint)")
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("other"))


#: Weights of the query: four domains 4:3:2:1, others 1; English 6, other languages 2; sources alike.
def weights_of_query() -> dict[str, Column]:
    by_domain = F.when(F.col("domain") == "domain0", 4).when(F.col("domain") == "domain1", 3)
    by_domain = by_domain.when(F.col("domain") == "domain2", 2).otherwise(1)
    return {"domain": by_domain, "lang": F.when(F.col("lang_leaf") == "en", 6).otherwise(2), "source": F.lit(1)}


def mixed(
    docs: DataFrame, share: float = 0.6, epochs: int = 2, weights: dict[str, Column] | None = None, seed: int = 42
) -> DataFrame:
    """``docs`` with domain, lang_leaf, source_leaf, n_tokens, n_copies: how often the mixture
    takes each document. Clashing columns of the input are replaced."""
    docs = docs.drop(*LEVELS, "n_tokens", "n_copies")
    treed = (
        docs.withColumn("domain", domain_of(F.col("source")))
        .withColumn("lang_leaf", F.coalesce("lang", F.lit("(none)")))
        .withColumn("source_leaf", F.coalesce("source", F.lit("(none)")))
        .withColumn("n_tokens", tokens_of(text_of("text")))
    )
    slim = written(treed.select("doc_id", *LEVELS, "n_tokens"), "tree")
    found = plan(slim, share, epochs, weights or weights_of_query(), seed)
    found = written(found.select(*LEVELS, F.col("whole").alias("_whole"), F.col("last_key").alias("_last")), "plan")
    key = order_key(seed, F.col("_whole"), F.col("doc_id"))
    return treed.join(found, list(LEVELS)).select(
        *[c for c in docs.columns], *LEVELS, "n_tokens",
        (F.col("_whole") + (key <= F.col("_last")).cast("long")).alias("n_copies"),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture: ``docs`` with each row as often as it was taken, and ``epoch`` (with
    underscores in front where ``docs`` has such a column)."""
    apart, restored = set_aside(docs, *LEVELS, "n_tokens", "n_copies", "_whole", "_last")
    taken = mixed(apart, **options).where("n_copies > 0")
    epoch = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias(free_name(docs, "epoch"))
    return taken.select(*restored(taken), epoch)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", *LEVELS, "n_tokens", "n_copies")


def sql(documents: str = "documents", share: float = 0.6, epochs: int = 2, seed: int = 42) -> str:
    """The statements of the query's mixture over ``documents``, up to the CTE ``mixed``."""

    def filling(nodes: str, parent: str, node: str, budget: str, quota: str) -> str:
        return f"""
  SELECT *, CASE WHEN weight <= 0 THEN 0 WHEN top IS NULL OR ratio <= top THEN supply
                 ELSE floor(top * weight + 1e-6)::BIGINT END AS {quota}
  FROM (SELECT *, max(CASE WHEN level < ratio THEN level END) OVER (PARTITION BY {parent}) AS top
    FROM (SELECT *, ({budget} - coalesce(sum(supply) OVER before, 0))::DOUBLE
          / nullif(sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER before, 0), 0)::DOUBLE AS level
      FROM (SELECT *, CASE WHEN weight > 0 THEN supply::DOUBLE / weight ELSE 1e300 END AS ratio FROM ({nodes}))
      WINDOW before AS (PARTITION BY {parent} ORDER BY ratio, {node}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""

    key = f"('0x' || substr(md5(concat('{seed}:', whole, ':', coalesce(doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT"
    return rf"""
tree AS (
  SELECT *, coalesce(lang, '(none)') AS lang_leaf, coalesce(source, '(none)') AS source_leaf,
    coalesce('domain' || (try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT)
                          % 4), 'other') AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM {documents}),
leaves AS (SELECT domain, lang_leaf, source_leaf, sum(n_tokens)::BIGINT AS tokens,
                  (sum(n_tokens) * {epochs})::BIGINT AS supply FROM tree GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {share}::DOUBLE)::BIGINT AS budget FROM leaves),
tops AS ({filling('''SELECT domain, 0 AS one, sum(supply)::BIGINT AS supply, any_value(budget) AS budget,
    CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight
    FROM leaves, total GROUP BY domain''', 'one', 'domain', 'budget', 'domain_quota')}),
middles AS ({filling('''SELECT l.domain, lang_leaf, sum(l.supply)::BIGINT AS supply, any_value(domain_quota) AS domain_quota,
    CASE lang_leaf WHEN 'en' THEN 6 ELSE 2 END AS weight
    FROM leaves l JOIN tops USING (domain) GROUP BY ALL''', 'domain', 'lang_leaf', 'domain_quota', 'lang_quota')}),
lasts AS ({filling('''SELECT l.domain, l.lang_leaf, source_leaf, l.tokens, l.supply, lang_quota, 1 AS weight
    FROM leaves l JOIN middles USING (domain, lang_leaf)''', 'domain, lang_leaf', 'source_leaf', 'lang_quota', 'quota')}),
quotas AS (SELECT domain, lang_leaf, source_leaf, tokens, quota,
                  CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS whole FROM lasts),
mixed AS (
  SELECT *, whole + (sum(n_tokens) OVER (PARTITION BY domain, lang_leaf, source_leaf ORDER BY key)
                     <= quota - whole * tokens AND tokens > 0)::BIGINT AS n_copies
  FROM (SELECT *, {key} AS key FROM tree JOIN quotas USING (domain, lang_leaf, source_leaf)))"""


SQL = f"""WITH {sql()}
SELECT doc_id, domain, lang_leaf, source_leaf, n_tokens, n_copies FROM mixed
"""
