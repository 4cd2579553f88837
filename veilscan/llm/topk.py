"""Exact top-k search by inner product, with distributed histogram selection.

Every component becomes floor(``scale`` * x), so scores are whole numbers and order is exact. Queries
are rows of the table itself; each meets all other rows. Both are dealt by hashed row numbers, rows to
slices of about ``SLICE``, queries to blocks of about ``BLOCK``, and a cell scores one block against one
slice: it holds the block's vectors and streams the slice's through one matrix product at a time.

The k-th highest score of each query is located, not merged: every cell counts all its scores in a
histogram of 2^``BIN_BITS`` equal ranges, the histograms of a query are added up over the cells, and the range
that holds the k-th value is cut again until it is one number. A cell leaves out ranges
that lie below k scores of its own, which cannot hold the k-th. Then the scores are filtered by their
query's value; of those equal to it a cell passes on only as many as are still wanted, by smallest id,
and a row number over the few that are left breaks ties.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do
those whose squared length passes 2^61, as their scores would not fit; a component that a shorter vector
lacks counts as 0; ties go to the smaller vec_id, null last, then to the earlier row; rows that share an
id are rows of their own, and a query leaves out only its own row; extra columns are ignored; fewer than
k other rows: all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.tables import table, written
from veilscan.session import ship_by_value

ship_by_value(__name__)

K = 5
SCALE = 256
SLICE = 4096
BLOCK = 4096
BIN_BITS = 10
#: Scores worked on at once.
TILE = 1 << 21
#: Stands for the k-th score of queries that have fewer than k; below all scores.
NO_LIMIT = -(1 << 62)
CELL = "slice int, block int, kind int, row long, vec_id long, vector binary, low long, above long"


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, row, parts array<long>, square: the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    parts = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.where(x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.withColumn("square", square).where(F.col("square") < float(1 << 61)).withColumn(
        "row", F.monotonically_increasing_id())


def packed(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """row, vec_id, vector: the parts as bytes of ``width`` numbers, missing ones as 0."""

    def run(batches):
        for batch in batches:
            parts = batch.column(2)
            size = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(size), width), kind)
            out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            bytes_ = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bytes_], ["row", "vec_id", "vector"])

    return rows.select("row", "vec_id", "parts").mapInArrow(run, "row long, vec_id long, vector binary")


def cells(rows: DataFrame, queries: DataFrame, slices: int, blocks: int) -> DataFrame:
    """Rows of ``CELL`` by cell: the queries of its block (kind 0), then the rows of its slice by id."""
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(
        spread(slices).alias("slice"), part(blocks).alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "vector", "low", "above")
    right = rows.select(
        part(slices).alias("slice"), spread(blocks).alias("block"), F.lit(1).alias("kind"), "row", "vec_id", "vector",
        F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    tasks = min(slices * blocks, 64 * rows.sparkSession.sparkContext.defaultParallelism)
    return left.union(right).repartition(tasks, "slice", "block").sortWithinPartitions(
        "slice", "block", "kind", F.col("vec_id").isNull(), "vec_id", "row")


class Block:
    """The queries of one cell; ``scores`` yields tiles of scores against rows that come in order."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, kind: str, number: str):
        whole = pa.Table.from_batches(parts).combine_chunks()
        self.width, self.kind, self.number = width, kind, number
        self.row, self.low, self.above = (whole.column(c).to_numpy() for c in ("row", "low", "above"))
        self.ids = whole.column("vec_id")
        self.matrix = self.vectors(whole.column("vector")).T.copy()
        self.order = np.argsort(self.row)

    def vectors(self, column) -> np.ndarray:
        data = b"".join(column.to_pylist())
        return np.frombuffer(data, self.kind).reshape(-1, self.width).astype(self.number)

    def scores(self, part: pa.RecordBatch):
        """(first row of the tile, scores as rows x queries, (row, query) places that are a query's own)."""
        rows, step = part.column(3).to_numpy(), max(1, TILE // len(self.row))
        matrix = self.vectors(part.column(5))
        at = self.order[np.minimum(np.searchsorted(self.row, rows, sorter=self.order), len(self.row) - 1)]
        own = self.row[at] == rows
        for s in range(0, len(rows), step):
            e = min(s + step, len(rows))
            mine = np.flatnonzero(own[s:e])
            yield s, (matrix[s:e] @ self.matrix).astype(np.int64), (mine, at[s:e][mine])


def per_cell(batches, width: int, kind: str, number: str):
    """(block, parts of its slice, one after the other) of each cell."""

    def segments():
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                if e > s:
                    yield tuple(keys[:2, s]), int(keys[2, s]), batch.slice(s, e - s)

    cell, queries, block = None, [], None
    for name, is_row, part in segments():
        if name != cell:
            if block is not None:
                yield block, None
            cell, queries, block = name, [], None
        if not is_row:
            queries.append(part)
        elif queries:
            block = block or Block(queries, width, kind, number)
            yield block, part
    if block is not None:
        yield block, None


def histograms(cells_: DataFrame, shift: int, bins: int, k: int, shape: tuple) -> DataFrame:
    """row, bin, n: how many scores of each query lie in each range of 2^``shift`` from its ``low`` on."""

    def run(batches):
        count = None
        for block, part in per_cell(batches, *shape):
            if count is None:
                count = np.zeros(len(block.row) * bins, np.int64)
            if part is not None:
                base = np.arange(len(block.row)) * bins
                for _, score, own in block.scores(part):
                    at = (score - block.low) >> shift
                    inside = (at >= 0) & (at < bins)
                    inside[own] = False
                    count += np.bincount((at + base)[inside], minlength=len(count))
                continue
            count = count.reshape(-1, bins)
            higher = count[:, ::-1].cumsum(axis=1)[:, ::-1] - count
            query, bin_ = np.nonzero((count > 0) & (higher < (k - block.above)[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.row[query]), pa.array(bin_, pa.int32()), pa.array(count[query, bin_])], ["row", "bin", "n"])
            count = None

    return cells_.mapInArrow(run, "row long, bin int, n long")


def located(queries: DataFrame, counted: DataFrame, shift: int, k: int) -> DataFrame:
    """``queries`` with ``low`` and ``above`` (scores beyond the range) of the range with the k-th score; a
    query with fewer than k scores keeps them all: its low is below every score, and none is wanted of ties."""
    downwards = Window.partitionBy("row").orderBy(F.col("bin").desc())  # at most 2^BIN_BITS ranges a query
    upto = counted.groupBy("row", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(downwards))
    found = upto.join(queries.select("row", "low", "above"), "row").where(
        (F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
    found = found.select("row", (F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("low"),
                         (F.col("above") + F.col("upto") - F.col("n")).alias("above"))
    return queries.drop("low", "above").join(found, "row", "left").withColumn(
        "low", F.coalesce("low", F.lit(NO_LIMIT))).withColumn("above", F.coalesce("above", F.lit(k).cast("long")))


def winners(cells_: DataFrame, k: int, shape: tuple) -> DataFrame:
    """query, query_id, vec_id, row, score: above the k-th score all, of those equal to it the first by id
    that are still wanted."""

    def run(batches):
        ties = None
        for block, part in per_cell(batches, *shape):
            if part is None:
                ties = None
                continue
            if ties is None:
                ties = np.zeros(len(block.row), np.int64)
            wanted = k - block.above
            for s, score, own in block.scores(part):
                keep = score > block.low
                equal = score == block.low
                keep[own] = equal[own] = False
                if equal.any():
                    nth = equal.cumsum(axis=0) + ties
                    keep |= equal & (nth <= wanted)
                    ties = nth[-1]
                at, query = np.nonzero(keep)
                where = pa.array(at + s)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.row[query]), block.ids.take(pa.array(query)).combine_chunks(),
                    part.column(4).take(where), part.column(3).take(where), pa.array(score[at, query]),
                ], ["query", "query_id", "vec_id", "row", "score"])

    return cells_.mapInArrow(run, "query long, query_id long, vec_id long, row long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of ``vectors(vec_id, embedding)`` for each row
    that ``is_query`` (an expression over vec_id) picks."""
    rows = whole(vectors, scale)
    facts = rows.agg(
        F.max(F.size("parts")).alias("width"), F.max("square").alias("square"), F.count(F.lit(1)).alias("n"),
        F.max(F.array_max(F.transform("parts", F.abs))).alias("largest"), F.count_if(is_query).alias("queries"),
    ).first()
    width, largest = max(1, facts["width"] or 0), facts["largest"] or 0
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    bound = math.ceil(facts["square"] or 0.0) + 1  # no score is larger than the longest vector's own
    number = "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64"
    shape = (width, kind, number)
    data = written(packed(rows, width, kind), "vectors")
    shift = max(BIN_BITS, (2 * bound).bit_length())
    queries = data.where(is_query).withColumn("low", F.lit(-bound)).withColumn("above", F.lit(0).cast("long"))
    queries = queries.withColumn("low", F.col("low").cast("long"))
    slices, blocks = max(1, -(-facts["n"] // SLICE)), max(1, -(-facts["queries"] // BLOCK))
    while shift > 0:
        bits = min(BIN_BITS, shift)
        shift -= bits
        counted = histograms(cells(data, queries, slices, blocks), shift, 1 << bits, k, shape)
        queries = written(located(queries, counted, shift, k), "located")
    found = winners(cells(data, queries, slices, blocks), k, shape)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS nr, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.nr AS q_nr, v.vec_id, v.nr, list_dot_product(q.parts, v.parts)::BIGINT AS score
  FROM v AS q JOIN v ON q.nr <> v.nr WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_nr ORDER BY score DESC, vec_id NULLS LAST, nr) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
