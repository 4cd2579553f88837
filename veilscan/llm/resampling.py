"""Importance resampling of documents towards a target collection, with an exact cutoff.

Texts become words (letters, digits and everything beyond ASCII; A-Z lower-cased) and features, which
are all words and all pairs of neighbours, hashed into ``BUCKETS`` buckets. A bucket's gain is the
logarithm of its share in the target over its share in all documents, in whole thousandths; a document
is scored as an array: gains taken by bucket, their floored mean is the weight, and seeded Gumbel noise
is added. The highest scores among the documents that are long enough are drawn.

The cutoff is found by weighted medians of medians. Every task takes the median of the keys it still
has, at most ``CHUNK`` of them at a time; the median of these medians, weighted by how many keys each
stands for, splits the remaining keys so that at least a quarter goes in every round, until the key at
the wanted place is met. Keys are (score, id, row), so no two are equal and exactly as many documents
are drawn as were asked for. Only the winners are sorted, by range over all tasks, which numbers them
without a window over the whole table.

Defined results: null or empty text, and text without words, has no features and weight 0; a null id
draws noise of its own like any id (equal ids draw equal noise) and comes last among ties; rows of equal
score and id are drawn in the order of their rows; extra columns are kept, and where the input already
has a column of a result's name the result gets underscores in front; an empty table gives an empty
result, an empty target gains that favour rare buckets.
"""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.tables import free_name, table, written
from veilscan.session import ship_by_value

ship_by_value(__name__)

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
#: Keys a median is taken of at once.
CHUNK = 1 << 20
#: Tables of keys larger than this are written anew when three quarters have gone.
WORTH_WRITING = 1_000_000

KEY = ("_a", "_b", "_c", "_d")
#: A-Z to a-z, other bytes outside of words to spaces.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def features(text: bytes) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every word and of every pair of neighbours)."""
    words = text.translate(WORD_BYTES).split()
    if not words:
        return 0, np.zeros(0, np.int64)
    one = list(map(crc32, words))
    # A CRC goes on where another ended: the pair's is that of the first word, a space and the second.
    two = map(crc32, words[1:], map(crc32, repeat(b" "), one))
    return len(words), np.array([*one, *two], np.int64) % BUCKETS


def each_text(column: pa.Array):
    """The texts of a column as bytes, null as empty."""
    return (t or b"" for t in column.cast(pa.large_binary()).to_pylist())


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``texts(text)``."""

    def run(batches):
        # Short texts are counted together: a vector of all buckets for each would cost more than its words.
        for batch in batches:
            held, size = [], 0
            total = np.zeros(BUCKETS, np.int64)
            for text in each_text(batch.column(0)):
                held.append(features(text)[1])
                size += len(held[-1])
                if size >= 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of log(target share / raw share) of each bucket, one added to every count."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target)))
        for s, t in zip(raw.tolist(), target.tolist())
    ], np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """struct(n_words, n_features, weight) of a text."""
    kind = "n_words long, n_features long, weight long"

    @F.arrow_udf(f"struct<{kind.replace(' long', ':bigint')}>")
    def of(texts: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for k, text in enumerate(each_text(texts)):
            n, bucket = features(text)
            out[:, k] = n, len(bucket), gain[bucket].sum() // max(1, len(bucket))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in kind.split(", ")])

    return of(text)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise by the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def before(keys: np.ndarray, pivot: tuple) -> np.ndarray:
    """Which columns of ``keys`` come before ``pivot``."""
    out = np.zeros(keys.shape[1], bool)
    for column, value in zip(keys[::-1], pivot[::-1]):
        out = (column < value) | ((column == value) & out)
    return out


def halves(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list[tuple]:
    """(side, n, median) of the keys strictly between ``low`` and ``high``, before (0) and after (1)
    ``pivot``: one row for each side of each chunk."""

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            part = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            inside = np.ones(part.shape[1], bool)
            if low is not None:
                inside &= ~before(part, (*low[:-1], low[-1] + 1))
            if high is not None:
                inside &= before(part, high)
            held.append(part[:, inside])
            size += held[-1].shape[1]
            if size >= CHUNK:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
        if size:
            yield np.concatenate(held, axis=1)

    def run(batches):
        rows = []
        for part in chunks(batches):
            first = np.zeros(part.shape[1], bool) if pivot is None else before(part, pivot)
            rest = ~first
            if pivot is not None:
                rest &= (part != np.array(pivot, np.int64)[:, None]).any(axis=0)
            for side, chosen in ((0, first), (1, rest)):
                some = part[:, chosen]
                n = some.shape[1]
                if n:
                    order = np.lexsort(some[::-1])
                    rows.append((side, n, *some[:, order[(n - 1) // 2]].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["side", "n", *KEY])

    found = keys
    if low is not None:  # reaches the scan; the exact test is that of the whole key
        found = found.where(F.col(KEY[0]) >= low[0])
    if high is not None:
        found = found.where(F.col(KEY[0]) <= high[0])
    rows = found.select(*KEY).mapInArrow(run, "side long, n long, " + ", ".join(f"{k} long" for k in KEY)).collect()
    return [(r[0], r[1], tuple(r[2:])) for r in rows]


def weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The least median with at least half of all weight at or before it."""
    total, upto = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        upto += n
        if 2 * upto >= total:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, k: int) -> tuple:
    """The k-th smallest of the distinct ``keys(_a, _b, _c, _d)``, k from 1; at least k exist."""
    low = high = pivot = None
    left, size = k, None
    while True:
        found = halves(keys, low, high, pivot)
        sides = [[(n, key) for side, n, key in found if side == s] for s in (0, 1)]
        below = sum(n for n, _ in sides[0])
        if pivot is not None and left == below + 1:
            return pivot
        if pivot is None or left > below + 1:
            low, left = (pivot, left - below - 1) if pivot is not None else (None, left)
            chosen = sides[1]
        else:
            high, chosen = pivot, sides[0]
        remaining = sum(n for n, _ in chosen)
        size = remaining if size is None else size
        if size > WORTH_WRITING and 4 * remaining <= size:
            inside = F.lit(True)
            if low is not None:
                inside &= key_struct() > key_struct(low)
            if high is not None:
                inside &= key_struct() < key_struct(high)
            keys, size = written(keys.where(inside).select(*KEY), "remaining-keys"), remaining
        pivot = weighted_median(chosen)


def key_struct(values: tuple | None = None) -> Column:
    columns = [F.col(c) for c in KEY] if values is None else [F.lit(v).cast("long").alias(c) for c, v in zip(KEY, values)]
    return F.struct(*columns)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3... in the order of their keys."""
    order = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id())
    order = written(order, "winners").withColumn("_part", F.shiftright("_at", 33))
    parts = order.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one per task
    starts, upto = [], 0
    for part, n in parts:
        starts.append((part, upto))
        upto += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    rank = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return order.join(F.broadcast(starts), "_part").withColumn(name, rank).drop("_at", "_part", "_start")


def resampled(
    docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_features, weight, score and rank (null where not drawn).

    ``share`` percent of the documents of at least ``least_words`` words are drawn towards
    ``target(text)``. ``keep``: columns of ``docs`` to return, all by default.
    """
    gain = gains(counts(docs), counts(target))
    keep = docs.columns if keep is None else keep
    slim = docs.select(*keep)
    names = {c: free_name(slim, c) for c in ("n_features", "weight", "score", "rank")}
    n_words, made = free_name(slim, "_words"), free_name(docs, "_made")
    doc_id = F.col("doc_id").cast("long")
    all_ = docs.withColumn(made, weighed(F.col("text"), gain)).select(
        *keep, F.col(f"{made}.n_words").alias(n_words), F.col(f"{made}.n_features").alias(names["n_features"]),
        F.col(f"{made}.weight").alias(names["weight"]),
        (F.col(f"{made}.weight") + noise(doc_id, seed)).alias(names["score"]),
        doc_id.isNull().cast("long").alias(KEY[1]), F.coalesce(doc_id, F.lit(0)).alias(KEY[2]),
        F.monotonically_increasing_id().alias(KEY[3]),
    )
    all_ = written(all_.withColumn(KEY[0], -F.col(names["score"])), "scores")
    long = all_.where(F.col(n_words) >= least_words)
    k = share * long.count() // 100
    none = F.lit(None).cast("long")
    results = [*keep, *names.values()]
    if not k:
        return all_.withColumn(names["rank"], none).select(results)
    last = key_struct(cutoff(long.select(*KEY), k))
    drawn = (F.col(n_words) >= least_words) & (key_struct() <= last)
    winners = numbered(all_.where(drawn), names["rank"]).select(results)
    return winners.union(all_.where(~drawn).withColumn(names["rank"], none).select(results))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


#: CRC-32 of UTF-8 bytes, for engines without one: a table of 256 steps, then a byte at a time.
SQL_CRC = """
  crc_steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps),"""


def sql_crc(text: str) -> str:
    """SQL for the CRC of ``text``, next to the CTE ``crc_steps``."""
    bytes_ = f"list_transform(range(len(hex(encode({text}))) // 2), lambda i: ('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295))"


SQL = rf"""
WITH {SQL_CRC}
texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS nr, text FROM documents UNION ALL
  SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
split AS (SELECT side, id, nr, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, nr, len(w) AS n_words,
    w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM split),
listed AS (SELECT side, nr, unnest(f) AS f FROM runs),
hashed AS (SELECT f, {sql_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM listed), crc_steps),
counted AS (SELECT side, nr, bucket, count(*) AS n FROM listed JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
         FROM counted GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT nr, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
            FROM counted JOIN gained USING (bucket) WHERE side = 0 GROUP BY nr),
scored AS (SELECT id AS doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE)
    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM runs LEFT JOIN weights USING (nr) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                  count(*) FILTER (n_words >= 20) OVER () AS long FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 25 * long // 100 THEN place END AS rank FROM ranked
"""
