"""SimHash near-duplicates through a hierarchical index in Gray order.

1. Fingerprints are made in one pass over the texts; equal ones are one from here on.
2. Distinct fingerprints in Gray order are cut into blocks at boundaries taken from a histogram
   of the top bits of their Gray rank. A block keeps the bits that all its members share.
3. These patterns (24 bytes for each of about ``BLOCKS`` blocks at most, whatever the input) are
   the upper nodes of the index: comparing them gives the pairs of blocks that can hold a link.
4. Each surviving pair of blocks is searched in a task of its own through the lower nodes. It
   returns a spanning forest of its links, at most one row per member: pairs that are already
   connected are neither compared nor returned.
5. Components of the forests are the groups.

Defined results: null text counts as empty; texts without words have fingerprint zero and link
like others; null ids get a component like other rows, named by the smallest id that is not null
(null if there is none); repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.links import Forest, close, components, gray_rank, gray_rank_column
from veilscan.llm.tables import set_aside, table, written
from veilscan.session import ship_by_value

ship_by_value(__name__)

CELL_BITS = 16
LEAST_BLOCK = 1 << 14
BLOCKS = 1 << 18


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())),
                    np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h))))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, print (64 bits as a long): one row per input row."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint_of((t or "").encode()) for t in batch.column(1).to_pylist()),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, "doc_id long, print long")


def blocks_of(prints: DataFrame) -> DataFrame:
    """block id, members (packed, in Gray order), ones, zeros. ``prints`` is distinct."""
    ranked = prints.withColumn("cell", F.shiftrightunsigned(gray_rank_column(F.col("print")), 64 - CELL_BITS))
    cells = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # at most 2^16 rows
    size = max(LEAST_BLOCK, -(-sum(c["n"] for c in cells) // BLOCKS))
    group, filled, named = 0, 0, []
    for c in cells:
        if filled and filled + c["n"] > size:
            group, filled = group + 1, 0
        filled += c["n"]
        named.append((c["cell"], group))
    spark = prints.sparkSession
    groups = spark.createDataFrame(named, "cell long, range long")

    def pack(key, pdf):
        import pandas as pd

        values = pdf["print"].to_numpy(np.int64).view(np.uint64)
        values = values[np.argsort(gray_rank(values))]
        rows = []
        for n, at in enumerate(range(0, len(values), size)):
            part = values[at : at + size]
            rows.append(((key[0] << 20) + n, part.tobytes(),
                         int(np.bitwise_and.reduce(part).view(np.int64)), int(np.bitwise_and.reduce(~part).view(np.int64))))
        return pd.DataFrame(rows, columns=["block", "members", "ones", "zeros"])

    return ranked.join(F.broadcast(groups), "cell").select("range", "print").groupBy("range").applyInPandas(
        pack, "block long, members binary, ones long, zeros long")


def block_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    """(a, b) with a <= b of the blocks that may hold a link, by their patterns."""
    upper = blocks.select("block", "ones", "zeros").orderBy("block").collect()
    ids = np.array([r[0] for r in upper], np.int64)
    ones, zeros = (np.array([r[k] for r in upper], np.int64).view(np.uint64) for k in (1, 2))

    def run(batches):
        for batch in batches:
            for me in batch.column(0).to_numpy():
                at = int(np.searchsorted(ids, me))
                near = np.bitwise_count((ones[at] & zeros[at:]) | (zeros[at] & ones[at:])) <= bits
                partners = ids[at:][near]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(partners), me)), pa.array(partners)], ["a", "b"])

    return blocks.select("block").mapInArrow(run, "a long, b long")


def forest(pairs: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) that connect what is linked across each pair of blocks."""

    def run(batches):
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x = np.frombuffer(left, np.uint64)
                y = None if a == b else np.frombuffer(right, np.uint64)
                shift = 0 if y is None else len(x)
                sets = Forest(len(x) + (0 if y is None else len(y)))
                close(x, y, bits, lambda i, j: sets.unite(i, j + shift),
                            lambda i, j: sets.of[i] == sets.of[j + shift])
                both = x if y is None else np.concatenate((x, y))
                moved = np.flatnonzero(sets.of != np.arange(len(both)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[moved].view(np.int64)), pa.array(both[sets.of[moved]].view(np.int64))], ["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, bits: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, print, component_id: one row per input row."""
    prints = written(fingerprints(docs, id_column, text_column), "prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    blocks = written(blocks_of(distinct.select("print")), "blocks")
    pairs = written(block_pairs(blocks, bits), "block-pairs")
    slim = blocks.select("block", "members")
    pairs = (
        pairs.join(slim.select(F.col("block").alias("a"), F.col("members").alias("left")), "a")
        .join(slim.select(F.col("block").alias("b"), F.col("members").alias("right")), "b")
        .repartition("a", "b")
    )
    found = components(forest(pairs, bits), "print-links").select(F.col("id").alias("print"), "component")
    named = distinct.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = written(named, "named-prints")
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "component").select("print", "component_id")
    return prints.join(named, "print")


def one_of_each(docs: DataFrame, bits: int = 2) -> DataFrame:
    """Rows of ``docs`` that stay, with its columns: one row of each group.

    It is a row of the smallest ``doc_id`` of the group (a null id only where there is no other).
    Only ids that name several rows are looked at again by text.
    """
    docs, restored = set_aside(docs, "_id", "_print", "_repeated", "_nth")
    found = written(grouped(docs, bits), "grouped")  # a join of its own, so that hot keys are split
    rows = found.groupBy("doc_id", "print", "component_id").agg(F.count(F.lit(1)).alias("n"))
    per_id = Window.partitionBy("doc_id")
    rows = rows.withColumn("of_id", F.sum("n").over(per_id))
    # The component of a null id without named neighbours is null too: told apart by the print.
    first = Window.partitionBy("component_id", F.when(F.col("component_id").isNull(), F.col("print"))).orderBy("print")
    stay = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("nth", F.row_number().over(first))
    stay = written(stay.where("nth = 1").select(
        F.col("doc_id").alias("_id"), F.col("print").alias("_print"), (F.col("of_id") > 1).alias("_repeated")), "stay")
    joined = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")))
    again = joined.where("_repeated")

    def with_print(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            own = np.array([fingerprint_of((t or "").encode()) for t in texts], np.uint64).view(np.int64)
            same = own == batch.column(batch.schema.get_field_index("_print")).to_numpy()
            yield batch.filter(pa.array(same))

    again = again.mapInArrow(with_print, again.schema)
    again = again.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_print").orderBy(F.xxhash64("text"))))
    joined, again = joined.where("not _repeated"), again.where("_nth = 1")
    return joined.select(restored(joined)).union(again.select(restored(again)))


def query(spark, sf_dir):
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
