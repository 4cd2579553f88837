"""Fingerprints of documents, the registered corpus, and containment matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilscan.constants import CONTAINMENT_THRESHOLD, SHINGLE_WORDS, WINNOW_WINDOW
from veilscan.functions import text as tx
from veilscan.functions.core import let, unnest
from veilscan.operators.set_overlap import HOT_PAIRS, Overlaps
from veilscan.operators.set_overlap import overlaps as set_overlaps
from veilscan.session import persist_table


def document_text(pages: DataFrame) -> DataFrame:
    """Pages of a job joined by line feeds in page order: (job_id, text).

    This puts each text into one row. Fingerprints do not need it: ``paged_prints`` works page by
    page.
    """
    return pages.groupBy("job_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n"
        ).alias("text")
    )


def fingerprint_sets(docs: DataFrame, hashing: str = "md5") -> DataFrame:
    """(job_id, fps, n): the winnowed set of each text and its size, computed in its row."""
    return docs.select(
        "job_id", tx.fingerprint(F.col("text"), hashing=hashing).alias("fps")
    ).withColumn("n", F.size("fps").cast("bigint"))


def fingerprint_rows(docs: DataFrame, hashing: str = "md5") -> DataFrame:
    """(job_id, h, n): one row per fingerprint, ``n`` the size of the document's set."""
    sets = fingerprint_sets(docs, hashing)
    return unnest(sets, F.col("fps"), "h", ("job_id", "n")).select("job_id", "h", "n")


# Pages per group when following words are gathered.
PAGE_GROUP = 1024


def page_parts(pages: DataFrame, k: int, window: int, hashing: str) -> DataFrame:
    """(job_id, page, n, head, tail, inside): what of a page its job's fingerprint needs, in one pass over
    the text: number of words, the first words (one full window), the last (one less), and the prints of
    the windows that lie within the page."""
    return pages.select("job_id", "page", parts_of(F.col("text"), k, window, hashing).alias("p")).select("job_id", "page", "p.*")


def parts_of(text: Column, k: int = SHINGLE_WORDS, window: int = WINNOW_WINDOW, hashing: str = "md5") -> Column:
    span = k + window - 1

    def parts(ws: Column) -> Column:
        n = F.size(ws)
        return F.struct(
            n.alias("n"), F.slice(ws, F.lit(1), F.lit(span)).alias("head"),
            F.slice(ws, F.greatest(n - span + 2, F.lit(1)), F.lit(span - 1)).alias("tail"),
            F.when(n >= span, tx.winnow(tx.word_shingles(ws, k, hashing), window)).alias("inside"),
        )

    return let(tx.words(text), parts)


def following_words(parts: DataFrame, count: int) -> DataFrame:
    """(job_id, page, head, tail, after): pages that have words, and the first ``count - 1`` words that come
    after each in its job.

    Pages of a job are numbered over fixed-size groups, and the first few of each group are
    also handed to the group before. So no task ever holds a whole job, however large it is,
    and only a few words per page move.
    """
    size = max(PAGE_GROUP, count)
    heads = parts.filter("n > 0").select("job_id", "page", "head", "tail", F.floor(F.col("page") / size).alias("part"))
    before = heads.groupBy("job_id", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(W.partitionBy("job_id").orderBy("part")) - F.col("n")
    ).drop("n")
    numbered = heads.join(before, ["job_id", "part"]).withColumn(
        "at", F.col("before") + F.row_number().over(W.partitionBy("job_id", "part").orderBy("page")) - 1
    )
    group = F.floor(F.col("at") / size)
    handed = F.when((F.col("at") % size < count) & (group > 0), F.array(group, group - 1)).otherwise(F.array(group))
    placed = numbered.select("job_id", "page", "head", "tail", "at", F.explode(handed).alias("group"))
    ahead = W.partitionBy("job_id", "group").orderBy("at").rowsBetween(1, count)
    return placed.withColumn(
        "after", F.slice(F.flatten(F.collect_list("head").over(ahead)), 1, count - 1)
    ).filter(F.col("group") == group).select("job_id", "page", "head", "tail", "after")


def paged_prints(
    pages: DataFrame, k: int = SHINGLE_WORDS, window: int = WINNOW_WINDOW, hashing: str = "md5"
) -> DataFrame:
    """Distinct (job_id, h) of jobs of many pages; shingles cross page breaks.

    Windows within a page are made in its row. A window that begins on a page and ends behind it lies in
    the last words of the page and the first that follow, one word short of a window each, so these words
    are all that moves. Jobs with fewer words than one full window are put together, which is at most that
    many words.
    """
    return joined_parts(persist_table(page_parts(pages, k, window, hashing), "page-parts"), k, window, hashing)


def joined_parts(
    parts: DataFrame, k: int = SHINGLE_WORDS, window: int = WINNOW_WINDOW, hashing: str = "md5"
) -> DataFrame:
    """The prints of jobs from the parts of their pages, which are read several times."""
    span = k + window - 1
    ahead = following_words(parts, span)

    def prints(ws: Column) -> Column:
        return let(ws, lambda x: tx.winnow(tx.word_shingles(x, k, hashing), window))

    inside = unnest(parts.filter("inside is not null"), F.col("inside"), "h", ("job_id",))
    across = unnest(
        ahead.select("job_id", F.concat("tail", "after").alias("ws")).filter(F.size("ws") >= span), prints(F.col("ws")), "h", ("job_id",)
    )
    tiny = parts.groupBy("job_id").agg(F.sum("n").alias("words")).filter(F.col("words").between(1, span - 1)).select("job_id")
    short = parts.filter("n > 0").join(tiny, "job_id", "left_semi").groupBy("job_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "head"))), lambda p: p["head"])).alias("ws")
    )
    return inside.unionByName(across).unionByName(unnest(short, prints(F.col("ws")), "h", ("job_id",))).distinct()


def sizes(prints: DataFrame) -> DataFrame:
    return prints.groupBy("job_id").agg(F.count("*").alias("n"))


def register(docs: DataFrame, hashing: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Corpus tables from ``docs(document_id, name, owner, severity, action, text)``: the
    registered documents and their fingerprints. A text without words is refused, that is, it
    appears in neither."""
    sets = docs.filter(tx.has_words(F.col("text"))).withColumn(
        "fps", tx.fingerprint(F.col("text"), hashing=hashing)
    )
    registered = sets.select(
        "document_id", "name", "owner", "severity", "action",
        tx.digest(F.col("text")).alias("exact_sha256"), F.size("fps").cast("bigint").alias("shingle_count"),
        F.lit(True).alias("enabled"),
    )
    return registered, unnest(sets, F.col("fps"), "h", ("document_id",))


def rejected_registrations(docs: DataFrame) -> DataFrame:
    return docs.filter(~tx.has_words(F.col("text"))).select("document_id", "name")


def unregister(registered: DataFrame, fingerprints: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the documents of ``gone(document_id)``; their fingerprints go with them."""
    return (
        registered.join(gone, "document_id", "left_anti"),
        fingerprints.join(gone, "document_id", "left_anti"),
    )


def shingle_counts(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints per document; one map-side pass removes repeats first."""
    return (
        fingerprints.select("document_id", "h").distinct()
        .groupBy("document_id").agg(F.count("*").alias("shingle_count"))
    )


def containment(overlap: Column, query_size: Column, reference_size: Column) -> Column:
    return F.least(
        F.lit(1.0),
        F.greatest(
            overlap / query_size.cast("double"), overlap / reference_size.cast("double")
        ),
    )


def enabled_corpus(fingerprints: DataFrame, registered: DataFrame) -> DataFrame:
    """(document_id, h) of the documents that take part."""
    return fingerprints.join(
        registered.filter("enabled and shingle_count > 0").select("document_id"), "document_id", "left_semi"
    ).select("document_id", "h")


def print_rows(docs: DataFrame, hashing: str) -> DataFrame:
    """Distinct (job_id, h) of ``docs(job_id, text)``, or ``docs(job_id, page, text)`` for many pages."""
    if "page" in docs.columns:
        return paged_prints(docs, hashing=hashing)
    return unnest(docs, tx.fingerprint(F.col("text"), hashing=hashing), "h", ("job_id",))


def class_overlaps(
    prints: DataFrame, fingerprints: DataFrame, registered: DataFrame, threshold: float = 0.0, hot_pairs: int = HOT_PAIRS,
    count_ids: bool = False,
) -> Overlaps:
    """Overlaps of classes of equal fingerprint sets: those of ``prints(job_id, h)`` on the left, registered
    documents on the right."""
    prints = persist_table(prints.select(F.col("job_id").alias("id"), "h"), "prints")
    corpus = persist_table(fingerprints.select(F.col("document_id").alias("id"), "h"), "corpus")
    taking_part = registered.filter("enabled and shingle_count > 0").select(F.col("document_id").alias("id"))
    return set_overlaps(prints, corpus, threshold, hot_pairs, taking_part, count_ids)


def members(found: Overlaps, documents: DataFrame | None = None) -> DataFrame:
    """All pairs of ids from those of classes: (job_id, document_id, overlap, query_n, reference_n), and the columns
    of ``documents(document_id, ...)``, which are joined before there are pairs, since these are far more."""
    right = found.right.select(F.col("id").alias("document_id"), F.col("class").alias("right"))
    more = []
    if documents is not None:
        right, more = right.join(documents, "document_id"), [c for c in documents.columns if c != "document_id"]
    return (
        found.pairs
        .join(found.left.select(F.col("id").alias("job_id"), F.col("class").alias("left")), "left")
        .join(right, "right")
        .select("job_id", "document_id", *more, "overlap", F.col("left_n").alias("query_n"), F.col("right_n").alias("reference_n"))
    )


def overlaps(docs: DataFrame, fingerprints: DataFrame, registered: DataFrame, hashing: str = "md5") -> DataFrame:
    """Shared fingerprints of all pairs that share any: (job_id, document_id, overlap, query_n, reference_n)."""
    return members(class_overlaps(print_rows(docs, hashing), fingerprints, registered))


def corpus_matches(
    docs: DataFrame, registered: DataFrame, fingerprints: DataFrame,
    threshold: float = CONTAINMENT_THRESHOLD, hashing: str = "md5", hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Registered documents each text is contained in, or contains, at ``threshold`` or more."""
    return matches_of_prints(print_rows(docs, hashing), registered, fingerprints, threshold, hot_pairs)


def matches_of_prints(
    prints: DataFrame, registered: DataFrame, fingerprints: DataFrame, threshold: float = CONTAINMENT_THRESHOLD,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """The same of texts whose ``prints(job_id, h)`` are known."""
    documents = registered.select("document_id", F.col("name").alias("document_name"), "severity", "action")
    found = members(class_overlaps(prints, fingerprints, registered, threshold, hot_pairs), documents)
    found = found.withColumn("ratio", containment(F.col("overlap"), F.col("query_n"), F.col("reference_n")))
    return found.filter(F.col("ratio") >= F.lit(threshold)).select("job_id", "document_id", "document_name", "severity", "action", "overlap", "ratio")


def match_classes(
    docs: DataFrame, registered: DataFrame, fingerprints: DataFrame, threshold: float = CONTAINMENT_THRESHOLD,
    hashing: str = "md5",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches without their copies: (one row per pair of classes with the members on both sides counted,
    the class of each text, the class of each registered document)."""
    found = class_overlaps(print_rows(docs, hashing), fingerprints, registered, threshold, count_ids=True)
    pairs = found.pairs.select(
        F.col("left").alias("job_class"), F.col("right").alias("document_class"), F.col("left_ids").alias("jobs"),
        F.col("right_ids").alias("documents"), "overlap",
        containment(F.col("overlap"), F.col("left_n"), F.col("right_n")).alias("ratio"),
    )
    return (
        pairs, found.left.select(F.col("id").alias("job_id"), F.col("class").alias("job_class")),
        found.right.select(F.col("id").alias("document_id"), F.col("class").alias("document_class")),
    )


def exact_copies(docs: DataFrame, registered: DataFrame) -> DataFrame:
    """Documents whose body equals a registered one byte for byte."""
    return docs.select("job_id", tx.digest(F.col("text")).alias("exact_sha256")).join(
        registered.filter("enabled").select("document_id", "exact_sha256"), "exact_sha256"
    )


def copy_groups(docs: DataFrame, registered: DataFrame) -> DataFrame:
    """Exact copies as groups: (exact_sha256, first_job, jobs, first_document, documents). Each side is
    counted before they meet, so a body that many jobs and many documents have makes one row."""
    jobs = docs.select("job_id", tx.digest(F.col("text")).alias("exact_sha256")).groupBy("exact_sha256").agg(
        F.min("job_id").alias("first_job"), F.count("*").alias("jobs"))
    documents = registered.filter("enabled").groupBy("exact_sha256").agg(
        F.min("document_id").alias("first_document"), F.count("*").alias("documents"))
    return jobs.join(documents, "exact_sha256")


def overlap_label(ratio: Column) -> Column:
    return F.format_string("%d%% overlap", F.bround(ratio * 100).cast("int"))
