"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words, signs and their pairs) are counted: one of the
target texts, one of the raw texts. A document's log weight is the sum of log(target / raw) over
its n-grams; adding Gumbel noise and taking the k largest draws k documents without replacement
in proportion to their weights. The ratios are centred so that target text has an expected log
weight of 0 at any length; otherwise long documents would be taken for their length alone.

The raw model counts all documents. The target model counts the documents that the labels call
good and not toxic, at most ``MAX_TARGET`` of them (those with the smallest hashed ids). k is the
target's share of the labelled documents times the number of documents, unless given.

The k largest keys are found by their leading bits: four counts over at most 65,536 ranges each,
so nothing is sorted and no list of keys is gathered.

Defined results: null or empty text has no n-grams and weight 0; a null id draws like any other
(equal ids draw equal noise); documents that tie with the last one taken are taken too; without
good labels all weights are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.tables import table, written
from veilscan.llm.words import LOWER, SPACE, mix, pieces, spans_hash
from veilscan.session import ship_by_value

ship_by_value(__name__)

BUCKETS = 1 << 18
MAX_TARGET = 50_000
ADDED = 2.0

#: 0 white space, 1 letters and digits (and bytes of other letters), 2 signs
KIND = np.where(SPACE, 0, 2).astype(np.uint8)
KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
KIND[128:] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all single tokens and pairs of neighbours. Tokens are runs of letters and
    digits, or of signs; a pair of equal tokens is one bucket whatever the token."""
    data = LOWER[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | head[:-1]
    start = np.flatnonzero(change)
    end = np.concatenate((start[1:], [n]))
    token = kind[start] > 0
    start, end = start[token], end[token]
    row = np.searchsorted(offsets, start, "right") - 1
    one = spans_hash(data, start, end, 0)
    pair = np.where(one[1:] == one[:-1], np.uint64(1), mix(one[:-1] * np.uint64(3) + one[1:]))
    same = row[1:] == row[:-1]
    keys = np.concatenate((one, pair[same]))
    return (keys % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((row, row[1:][same]))


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, from ``docs(text, good)``."""

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for first, end, data, offsets in pieces(batch.column(0)):
                bucket, row = features(data, offsets)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[first:end][row]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])],
                                         ["bucket", "raw", "target"])

    rows = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"].to_numpy(int)], target[rows["bucket"].to_numpy(int)] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    # Counts against those expected from the raw model, both with a few added: rare n-grams say little.
    expected = raw / raw.sum() * target.sum()
    ratio = np.log((target + ADDED) / (expected + ADDED))
    # Centred on the target: good text has an expected weight of 0 whatever its length.
    return np.where(raw > 0, ratio - (target * ratio).sum() / target.sum(), 0).astype(np.float32)


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id, good: one row per labelled document; several labels must agree to be good."""
    found = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return found.select("doc_id", F.coalesce(good, F.lit(False)).alias("good"))


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order, within 2^-40: fixed point from the least weight up."""
    return F.floor((value + F.lit(float(1 << 22))) * F.lit(float(1 << 40))).cast("long")


def smallest_taken(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of ``keys(key)``, 64-bit and not negative; None if there are fewer."""
    known, left = 0, k
    for shift in (48, 32, 16, 0):
        inside = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16) == known)
        ranges = inside.groupBy(F.shiftright("key", shift).alias("range")).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(ranges.collect(), reverse=True):  # at most 2^16 rows
            if left <= row["n"]:
                known = row["range"]
                break
            left -= row["n"]
        else:
            return None
    return known


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight, n_features: one row per document."""

    def run(batches):
        for batch in batches:
            weight, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, end, data, offsets in pieces(batch.column(1)):
                bucket, row = features(data, offsets)
                weight[first:end] = np.bincount(row, ratios[bucket], minlength=end - first)
                number[first:end] = np.bincount(row, minlength=end - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(number)],
                                             ["doc_id", "log_weight", "n_features"])

    return docs.mapInArrow(run, "doc_id long, log_weight double, n_features long")


def selected(
    docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42, max_target: int = MAX_TARGET
) -> DataFrame:
    """doc_id, log_weight, n_features, draw, selected: one row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(good_ids(labels), "labels")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")).first()
    sample = known.where("good").orderBy(F.xxhash64("doc_id")).limit(max_target).select("doc_id", "good")
    ratios = log_ratios(slim.join(F.broadcast(sample), "doc_id", "left").select(
        "text", F.coalesce("good", F.lit(False)).alias("good")))
    keys = weighed(slim, ratios).withColumn("draw", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    # The key's range holds weights up to 2^22; longer texts than that meet its ends and tie there.
    clipped = F.greatest(F.least(F.col("draw"), F.lit(float(1 << 22) - 1)), F.lit(1 - float(1 << 22)))
    keys = written(keys.withColumn("key", ordered_bits(clipped)), "weights")
    if k is None:
        k = round(keys.count() * counts["good"] / counts["n"]) if counts["n"] else 0
    last = smallest_taken(keys, k) if k > 0 else None
    taken = F.lit(k > 0) if last is None else F.col("key") >= last
    return keys.select("doc_id", "log_weight", "n_features", "draw", taken.alias("selected"))


def query(spark, sf_dir):
    return selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
