"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own characters say so, so equal stretches of two texts give equal
chunks. Chunks become identifiers: a 64-bit hash, plus a number that tells apart chunks whose
SHA-256 differs although the hash agrees. A document is then the ordered list of its chunks'
identifiers (its recipe), and documents are equal when their recipes are. Only hashes are
shuffled; a text is read once and never moves.

Defined results: a null text counts as empty; an empty text has the empty recipe, so all empty
texts form one group; of equal texts the largest ``doc_id`` stays, a null id only where the
group has no other; rows that repeat the winning id all stay; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.tables import text_of, written

# A chunk ends at the first cut after LEAST characters: a line end, or a word that ends in such a letter or digit and one that
# has another soon after its begin (one place in a hundred or so, in several scripts).
LEAST, MOST = 256, 16384
CUT = r"\n|[a-e0-2\u03B1-\u03B3\u0430-\u0434\u0627-\u062A][ ](?=.?[a-c0-2\u03B1\u03B2\u0430-\u0432\u0627\u0628])|[\u7684\u306E\u3002]"


def chunks(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """Content-defined chunks in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:{cut})|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256, recipe array<struct<id, nth>>.

    ``nth`` is 0 unless two different chunks share a 64-bit hash.
    """
    text = text_of(text_column)
    cut = written(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
            F.transform(
                chunks(text),
                lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")),
            ).alias("parts"),
        ),
        "chunks",
    )
    parts = cut.select("row", F.posexplode("parts").alias("pos", "part")).select("row", "pos", "part.*")
    same_id = Window.partitionBy("id").orderBy("sha")
    # A distinct chunk is one row here, so a partition of this window holds colliding chunks only.
    registry = parts.select("id", "sha").distinct().withColumn("nth", F.row_number().over(same_id) - 1)
    clashes = registry.where("nth > 0")
    listed = (
        parts.join(clashes, ["id", "sha"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", F.coalesce("nth", F.lit(0)).alias("nth")))).alias("r"))
        .select("row", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["nth"].alias("nth"))).alias("recipe"))
    )
    none = F.array().cast("array<struct<id:bigint,nth:int>>")
    return cut.drop("parts").join(listed, "row", "left").withColumn("recipe", F.coalesce("recipe", none))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    found = written(recipes(docs, id_column, text_column).drop("row"), "recipes")
    groups = found.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "groups")  # so that the join sees plain exchanges, whose hot keys are split
    return found.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def query(spark, sf_dir):
    from veilscan.llm.tables import table

    return deduplicate(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
