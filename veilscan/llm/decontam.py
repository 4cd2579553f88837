"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is worked off in blocks of at most ``BLOCK_BYTES`` of item text, so that what the
tasks are sent is bounded whatever its size. For each block:

1. the number of documents with each word n-gram of the items is counted over all documents,
   summed inside the tasks first;
2. in every stretch of neighbouring n-grams of an item the rarest ones become its seeds, so each
   part of an item has seeds, also where all of it is frequent;
3. the documents pass once more: where seeds of an item lie near each other, item and passage are
   aligned by words, and the best local alignment is scored as a share of the item's own score.

Documents are never shuffled; blocks are chained row by row. Words are compared in lower case
without punctuation.

Defined results: null or empty text is not contaminated, with score 0 and no items; items of
fewer than three words, which have no seed and would mark clean text, and null items match nothing; among equal scores the smallest item id is the best; items
that repeat an id are all compared; an empty table on either side gives no matches; extra columns
are kept.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from veilscan.llm.tables import set_aside, table
from veilscan.llm.words import LOWER, Words, pieces
from veilscan.session import ship_by_value

ship_by_value(__name__)

BLOCK_BYTES = 8 << 20
GRAM = 3
STRETCH, RARE = 4, 2
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5

#: ASCII signs other than letters and digits as space.
FOLD = LOWER.copy()
FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32

OUT = [("best_score", DoubleType(), pa.float64()), ("best_item", LongType(), pa.int64()),
       ("items", ArrayType(LongType()), pa.list_(pa.int64())), ("first_word", LongType(), pa.int64()),
       ("end_word", LongType(), pa.int64())]


class Items:
    """Word hashes and n-grams of one block of the benchmark."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.words, grams, item, at = [], [], [], [], []
        for id_, text in rows:
            ((_, _, data, offsets),) = pieces(pc.utf8_lower(pa.array([text or ""])))
            words = Words(FOLD[data], offsets)
            if id_ is None or not len(words.start):
                continue
            h = words.hashes()
            size = min(GRAM, len(h))
            g, good = words.grams(h, size)
            if size < GRAM:
                continue
            grams.append(g[good])
            item.append(np.full(good.sum(), len(self.ids)))
            at.append(np.arange(good.sum()))
            self.ids.append(id_)
            self.words.append(h)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.distinct = np.unique(self.grams)

    def keep_rare(self, frequency: np.ndarray) -> None:
        """Leaves the rarest grams of every stretch as seeds, sorted."""
        n = frequency[np.searchsorted(self.distinct, self.grams)]
        keep = np.zeros(len(n), bool)
        for s in range(STRETCH):
            group = self.item * (1 << 32) + (self.at + s) // STRETCH
            order = np.lexsort((self.at, n, group))
            ranked = group[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            nth = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
            keep[order[nth < RARE]] = True
        order = np.argsort(self.grams[keep], kind="stable")
        self.grams, self.item, self.at = (x[keep][order] for x in (self.grams, self.item, self.at))


class Filter:
    """Membership of hashes in a sorted set: a bit table first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(16, int(len(self.values)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.values >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, places in the set) of the members among the good ones."""
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & good)
        if not len(maybe) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, h[maybe]), len(self.values) - 1)
        true = self.values[place] == h[maybe]
        return maybe[true], place[true]


def frequencies(docs: DataFrame, distinct: np.ndarray) -> np.ndarray:
    """Number of documents with each of the n-grams (two equal ones in a text count once)."""
    known = Filter(distinct)

    def run(batches):
        total = np.zeros(len(distinct), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(pc.utf8_lower(batch.column(0))):
                words = Words(FOLD[data], offsets)
                at, place = known.hits(*words.grams(words.hashes(), GRAM))
                pairs = np.unique(words.doc[at] * len(distinct) + place)
                np.add.at(total, pairs % max(len(distinct), 1), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(distinct), np.int64)
    out[rows["gram"].to_numpy(int)] = rows["n"]
    return out


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(best local score as a share of the item's own, end in the passage) by Smith-Waterman."""
    best, end = 0, 0
    place = np.arange(1, len(passage) + 1) * -GAP
    above = np.zeros(len(passage) + 1, np.int64)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row + place) - place
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
        above = np.concatenate(([0], row))
    return best / (MATCH * len(item)), end


def passages(items: Items, spots: np.ndarray, places: np.ndarray, doc: np.ndarray, runs) -> list[tuple[int, int, int, int]]:
    """(row, item, from, to) of stretches of documents with two seeds of an item near each other,
    or one for items with fewer than two stretches."""
    found = defaultdict(list)
    for word, place in zip(spots.tolist(), places.tolist()):
        for k in range(runs[place], runs[place + 1]):
            found[(int(doc[word]), int(items.item[k]))].append((word, int(items.at[k])))
    out = []
    for (row, item), hits in found.items():
        size = len(items.words[item])
        slack, needed = size // 4 + 2, 2 if size >= GRAM + STRETCH else 1
        hits.sort()
        group: list[tuple[int, int]] = []
        for word, at in [*hits, (1 << 60, 0)]:
            if group and word - at - slack > max(w - a for w, a in group) + size + slack:
                if len({a for _, a in group}) >= needed:
                    low, high = min(w - a for w, a in group) - slack, max(w - a for w, a in group) + size + slack
                    out.append((row, item, low, high))
                group = []
            group.append((word, at))
    return out


def scored(docs: DataFrame, items: Items, least: float, first: bool) -> DataFrame:
    """``docs`` with the output columns, joined with those of earlier blocks unless ``first``."""
    seeds = Filter(items.grams)
    runs = np.searchsorted(items.grams, np.concatenate((seeds.values, [np.uint64((1 << 64) - 1)]))).tolist()
    runs[-1] = len(items.grams)
    names = [o[0] for o in OUT]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            best = [(0.0, None, [], None, None)] * n
            if not first:
                best = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)))
            for start, _, data, offsets in pieces(pc.utf8_lower(batch.column(batch.schema.get_field_index("text")))):
                words = Words(FOLD[data], offsets)
                h = words.hashes()
                spots, places = seeds.hits(*words.grams(h, GRAM))
                for row, item, low, high in passages(items, spots, places, words.doc, runs):
                    low, high = max(low, int(words.first[row])), min(high, int(words.first[row + 1]))
                    score, end = aligned(items.words[item], h[low:high])
                    old, id_ = best[start + row], items.ids[item]
                    where = (low - int(words.first[row]), low + end - int(words.first[row]))
                    if (score, -id_) > (old[0], -(old[1] if old[1] is not None else 1 << 62)):
                        old = (score, id_, old[2], *where)
                    if score >= least and id_ not in old[2]:
                        old = (*old[:2], sorted([*old[2], id_]), *old[3:])
                    best[start + row] = old
            more = [pa.array([b[k] for b in best], kind) for k, (_, _, kind) in enumerate(OUT)]
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), *more], [*kept, *names])

    fields = [f for f in docs.schema.fields if f.name not in names]
    return docs.mapInArrow(run, StructType([*fields, *(StructField(c, kind) for c, kind, _ in OUT)]))


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """The benchmark's (item_id, text) in lists of at most ``size`` bytes of text."""
    held, bytes_ = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        more = len((row[1] or "").encode())
        if held and bytes_ + more > size:
            yield held
            held, bytes_ = [], 0
        held.append((row[0], row[1]))
        bytes_ += more
    yield held


def matched(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with best_score, best_item, items (ids scoring ``least`` or more) and the words
    [first_word, end_word) around the best alignment; columns of these names are replaced."""
    docs = docs.drop(*[o[0] for o in OUT])
    found, first = docs, True
    for rows in blocks(benchmark):
        items = Items(rows)
        items.keep_rare(frequencies(docs, items.distinct))
        found, first = scored(found, items, least, first), False
    return found


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents without a benchmark item; same columns, with their values."""
    apart, restored = set_aside(docs, *[o[0] for o in OUT])
    found = matched(apart, benchmark, least).where(F.size("items") == 0)
    return found.select(restored(found))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "best_item", "best_score",
                        "items", "first_word", "end_word")
