"""Fuzzy line deduplication.

All lines that are not blank take part, normalised: lower case, runs of ASCII signs as one space.
Lines of fewer than ``MIN_CHARS`` characters, or that are mostly signs, only have their white space
normalised. Equal normalised lines are one line from then on (128-bit XXH3).
Two lines of at least ``MIN_CHARS`` characters are linked when they are candidates and similar:
1 - edit distance / longer length >= ``SIMILAR``, numbers and all.
Of each connected group the first occurrence by (doc_id, text hash, line number) stays; all others are
removed from their documents.

Candidates come in two ways. Lines that share many words (a character is a word where the script has
no spaces) meet in one of ``BANDS`` MinHash bands of ``ROWS`` values each; of these, pairs stay whose
sketches of 64 one-bit MinHashes differ in at most ``SKETCH_BITS``. Words of few bytes weigh less in both (``TIMES``): they
are in most lines, and lines that have only these in common would meet in numbers that grow with the square of the
lines. Where the texts meet, pairs of bands whose sketches of ``WIDE`` further bits differ in more than ``WIDE_BITS`` are
left out. Lines whose SimHashes over words
differ in at most ``BITS`` bits (each different word counts once) meet on pigeonhole blocks: with at most three differing bits
one of four 16-bit blocks is equal. In SimHashes numbers are alike if the line has few digits.

A first round moves only fingerprints, packed (``ENTRY``), with the lengths: lines whose lengths are too far apart are no
candidates. It yields candidate pairs, each of which is given to the lowest
key in which it meets, and of keys with very many pairs the lines that have a partner there. Only
texts of these lines are fetched, and each goes only to keys it has a pair in. A block or band that holds
many fingerprints is dealt over several tasks, each of which compares two slices of it. A pair is compared in the
first band in which both texts are, and once by SimHash; inside a task pairs that are already connected are neither
compared nor returned.

Defined results: null text stays null, empty text stays empty; white space, blank lines and the
order of lines are kept; null ids come last in the order; rows that share an id (or have none)
are told apart by a hash of their text, which also orders them; of rows with equal id and text one
counts as first, and every line that takes part goes from the others; extra columns are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.llm.links import Forest, close, components, gray_rank
from veilscan.llm.tables import set_aside, table, written
from veilscan.llm.words import Words, mix, pieces, row_sums
from veilscan.session import ship_by_value

ship_by_value(__name__)

#: Shorter lines are only removed where they are equal.
MIN_CHARS = 20
BITS = 3
BANDS = 15
ROWS = 3
SKETCH_BITS = 20
#: Bits of the sketch that candidate pairs have to be near in before their texts are compared, and how many may differ.
WIDE, WIDE_BITS = 192, 76
#: By what the MinHash of a word of so many bytes is multiplied, the last for all longer ones: short words win less often.
TIMES = np.array([8, 8, 4, 3, 2, 2, 1], np.uint32)
SIMILAR = 0.8
SLICE = 20_000
SMALL_BLOCK = 256
#: Pairs looked at at once, a quarter of those that wait for being compared together.
PAIRS = 8192
#: Characters of pairs whose edit distances are found together, and the pairs below which that does not pay.
TOGETHER = 1 << 20
ALONE = 24
#: Words of the table of where a character is in a text, for the pairs worked on together.
TABLE = 1 << 22
#: Texts from this length on are first compared within a part of the distance asked for: most copies are nearer.
LONG = 512
#: Columns after which is looked whether a distance can still be small enough.
LOOK = 64
#: Lines whose entries are packed at once, parts of the shuffle for each of its partitions, places in which keys are counted.
PACK = 1 << 14
PARTS = 8
PLACE_BITS = 20
#: A line in a block or band. ``key``: 29 bits of a hash of the block's or band's key and of the slices that meet, whether
#: it is a block, whether two slices meet, and which of the two the line is of. ``low``, ``high``: the line's id.
ENTRY = np.dtype([("key", "<u4"), ("value", "<u8"), ("low", "<u4"), ("high", "<u2"), ("chars", "<u2")])
BLOCK, MIXED, SIDE = 4, 2, 1
#: Blocks with more candidate pairs than this for each of their rows are verified as a whole.
DENSE = 8
#: Bits of the table that says which lines' texts are wanted.
TABLE_BITS = 24
LAST = (1 << 63) - 1

#: ASCII signs as spaces; line ends stay.
PLAIN = bytes(c if c == 10 or c > 127 or chr(c).isalnum() else 32 for c in range(256))
DIGITS = b"0123456789"
NUMBER = re.compile(rb"[0-9]+")


def normalised(text: str) -> str:
    """The normalised lines of a text, joined as they were."""
    plain = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    plain = plain.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").decode("utf-8", "surrogatepass")
    return "\n".join([
        x if len(x) >= MIN_CHARS and 5 * len(x) >= 4 * len(line) else form(x, line)
        for x, line in zip(plain.split("\n"), text.split("\n"))])


def form(plain: str, line: str) -> str:
    """``plain``, or the line itself with single spaces where that is short or lacks a fifth of it."""
    line = " ".join(line.split())
    return plain if len(plain) >= MIN_CHARS and 5 * len(plain) >= 4 * len(line) else line


def takes_part(line: str) -> bool:
    return line != ""


#: For each byte a word of eight counters that holds its bits.
LANES = np.array([sum(((x >> k) & 1) << (8 * k) for k in range(8)) for x in range(256)], np.uint64)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit is set among the hashes of each slice: slices x 64.

    Eight counters of eight bits are summed at once, over stretches of at most 255 hashes.
    """
    cuts = np.unique(np.concatenate((first, np.arange(0, first[-1], 255)))) if first[-1] else first[:1]
    out = np.zeros((len(first) - 1, 64), np.int64)
    if len(cuts) < 2:
        return out
    parts = np.zeros((len(cuts) - 1, 8), np.uint64)
    bytes_ = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LANES[bytes_[:, k]], dtype=np.uint64)))
        parts[:, k] = sums[cuts[1:]] - sums[cuts[:-1]]
    return row_sums(parts.view(np.uint8).reshape(-1, 64).astype(np.int64), np.searchsorted(cuts, first))


def first_of_line(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One of each set of equal hashes of a line."""
    line = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = mix(h + line * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    keep = np.ones(len(h), bool)
    keep[order[1:]] = both[order[1:]] != both[order[:-1]]
    return keep


def different(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each line, by 44 of their bits, mixed anew, and where lines begin (at most 2^20)."""
    n, left = len(first) - 1, np.uint64(44)
    line = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    both = np.sort((line << left) | (h >> (np.uint64(64) - left)))
    both = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
    return mix(both & ((np.uint64(1) << left) - np.uint64(1))), np.searchsorted(both >> left, np.arange(n + 1, dtype=np.uint64))


def numbers_alike(line: str) -> bytes:
    """The line with one digit for every number, if at most a third of it is digits: tables of numbers
    would else all be candidates of each other."""
    plain = line.encode("utf-8", "surrogatepass")
    digits = len(plain) - len(plain.translate(None, DIGITS))
    return NUMBER.sub(b"0", plain) if 0 < 3 * digits <= len(plain) else plain


def simhash_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each line over its different words."""
    one, first = different(hashes, first)
    set_ = bit_counts(one, first)
    return np.packbits(2 * set_ > np.diff(first)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(lines: list[str]) -> np.ndarray:
    """SimHash of each line over its different words (pairs would move more bits; with repeats, a sign between
    all words would decide every bit), numbers alike; of a short line a hash of the whole, which is near to
    itself only."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in pieces(pa.array([numbers_alike(x) for x in lines], pa.binary()), 1 << 19):
        words = Words(data, offsets)
        out.append(simhash_of(words.hashes(), words.first))
    prints = np.concatenate(out)
    for k, line in enumerate(lines):
        if len(line) < MIN_CHARS:
            prints[k] = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return prints


#: Scripts without spaces: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
SPACELESS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
ODD = np.random.default_rng(1).integers(1, 1 << 32, 64 + WIDE, dtype=np.uint32) | np.uint32(1)


#: First bytes of characters from U+0800 on.
HIGH = bytes(range(0xE0, 0x100))


def spaced(line: str) -> bytes:
    plain = line.encode("utf-8", "surrogatepass")
    if line.isascii() or len(plain.translate(None, HIGH)) == len(plain):
        return plain
    return SPACELESS.sub(r" \1 ", line).encode("utf-8", "surrogatepass")


def least_values(words: Words, hashes: np.ndarray, which: slice) -> Iterator[np.ndarray]:
    """For each number of ``ODD`` in ``which`` the least value of a word of each line. A word's value is the product of
    29 bits and its number in ``TIMES``, so that it is the least with a weight that goes down with this number."""
    h = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    v = np.empty_like(h)
    times = TIMES[np.minimum(words.end - words.start, len(TIMES)) - 1]
    for odd in ODD[which]:
        np.multiply(h, odd, out=v)
        v >>= np.uint32(3)
        v *= times
        yield np.minimum.reduceat(v, words.first[:-1])  # a line that takes part has a word


def one_bit(least: np.ndarray) -> np.ndarray:
    return (least * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)


def minhash_of(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketch of 64 bits, ``BANDS`` keys of 32 bits) of each line, over its set of words."""
    n = len(words.first) - 1
    sketch, key = np.zeros(n, np.uint64), np.zeros((BANDS, n), np.uint64)
    for k, least in enumerate(least_values(words, hashes, slice(0, 64))):
        sketch |= one_bit(least) << np.uint64(k)
        if k < BANDS * ROWS:
            key[k // ROWS] = key[k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least
    return sketch, np.ascontiguousarray(mix(key).astype(np.uint32).view(np.int32).T)


def wide_sketches(lines: list[str]) -> np.ndarray:
    """``WIDE`` further bits of each line: lines x words of 64 bits."""
    out = [np.zeros((0, WIDE // 64), np.uint64)]
    for first, end, data, offsets in pieces(pa.array([spaced(x) for x in lines], pa.binary()), 1 << 19):
        words = Words(data, offsets)
        sketch = np.zeros((end - first, WIDE // 64), np.uint64)
        for k, least in enumerate(least_values(words, words.hashes(), slice(64, None))):
            sketch[:, k // 64] |= one_bit(least) << np.uint64(k % 64)
        out.append(sketch)
    return np.concatenate(out)


def minhashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``minhash_of`` of each line."""
    sketches, keys = [np.zeros(0, np.uint64)], [np.zeros((0, BANDS), np.int32)]
    for _, _, data, offsets in pieces(pa.array([spaced(x) for x in lines], pa.binary()), 1 << 19):
        words = Words(data, offsets)
        sketch, key = minhash_of(words, words.hashes())
        sketches.append(sketch)
        keys.append(key)
    return np.concatenate(sketches), np.concatenate(keys)


def fingerprints(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``simhashes`` and ``minhashes`` of lines of at least ``MIN_CHARS`` characters. Words are hashed once for both,
    where both see the same ones."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, BANDS), np.int32))]
    plain = [spaced(x) for x in lines]
    for _, _, data, offsets in pieces(pa.array(plain, pa.binary()), 1 << 19):
        words = Words(data, offsets)
        hashes = words.hashes()
        out.append((simhash_of(hashes, words.first), *minhash_of(words, hashes)))
    prints, sketches, keys = (np.concatenate(side) for side in zip(*out))
    other = [k for k, p in enumerate(plain) if len(p.translate(None, DIGITS + HIGH)) != len(p)]  # or no other
    if other:
        prints[other] = simhashes([lines[k] for k in other])
    return prints, sketches, keys


def row_hash() -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64("text")


def occurrences(docs: DataFrame) -> DataFrame:
    """line binary(16), print long, sketch long, keys binary (``BANDS`` numbers of 32 bits; all three null of short lines),
    chars int, doc long (null as the largest), row long (hash of the text), nth int: lines that take part."""

    def run(batches):
        for batch in batches:
            kept = []
            for doc, text, row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for nth, line in enumerate(normalised(text or "").split("\n")):
                    if takes_part(line):
                        kept.append((line, LAST if doc is None else doc, row, nth))
            for at in range(0, len(kept), 5000):
                part = kept[at : at + 5000]
                number: dict[str, int] = {}
                of = pa.array([number.setdefault(k[0], len(number)) for k in part], pa.int32())
                lines = list(number)
                chars = np.array([len(x) for x in lines])
                short = chars < MIN_CHARS
                values, keys = np.zeros((2, len(lines)), np.uint64), np.zeros((len(lines), BANDS), np.int32)
                values[0, ~short], values[1, ~short], keys[~short] = fingerprints([x for x in lines if len(x) >= MIN_CHARS])
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BANDS), len(lines), [None, pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines], pa.binary()).take(of),
                    pa.array(values[0].view(np.int64), mask=short).take(of), pa.array(values[1].view(np.int64), mask=short).take(of),
                    pc.if_else(pa.array(short), pa.scalar(None, pa.binary()), keys.cast(pa.binary())).take(of),
                    pa.array(chars, pa.int32()).take(of),
                    pa.array([k[1] for k in part], pa.int64()), pa.array([k[2] for k in part], pa.int64()),
                    pa.array([k[3] for k in part], pa.int32()),
                ], ["line", "print", "sketch", "keys", "chars", "doc", "row", "nth"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("row"))
    return slim.mapInArrow(run, "line binary, print long, sketch long, keys binary, chars int, doc long, row long, nth int")


def of_width(column, dtype) -> np.ndarray:
    """A column of binary values of one width, none null, as numbers: rows x numbers of a value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), dtype)
    _, where, data = column.buffers()
    where = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]].view(dtype).reshape(len(column), -1)


def distinct_lines(occurrences: DataFrame) -> DataFrame:
    """Each line once, with its first place and ``n``, how often it occurs. Repeats end in the batch that has
    them, so a line that is everywhere sends a row for each batch."""

    def once(table_: pa.Table) -> pa.Table:
        table_ = table_.combine_chunks()
        low, high = of_width(table_["line"], np.uint64).T
        doc, row, nth, n = (np.asarray(table_[c]) for c in ("doc", "row", "nth", "n"))
        order = np.lexsort((nth, row, doc, high, low))
        start = np.flatnonzero(np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))))
        out = table_.take(pa.array(order[start]))
        return out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(n[order], start)))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield from once(pa.Table.from_batches([batch])).to_batches()

    def all_(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from once(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 14)

    rows = occurrences.withColumn("n", F.lit(1).cast("long"))
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(each, kind).repartition("line").mapInArrow(all_, kind)


def ids_of(lines: np.ndarray) -> np.ndarray:
    """48 bits of each hash of a line: where to look for it; lines that share them are all looked at."""
    return (lines[:, 0] & np.uint64((1 << 48) - 1)).astype(np.int64)


def block_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of the pigeonhole blocks: prints x 4."""
    at = np.arange(4, dtype=np.uint64)
    return (((prints[:, None] >> (at * np.uint64(16))) & np.uint64(0xFFFF)) | (at << np.uint64(16))).view(np.int64)


def band_keys(keys: np.ndarray) -> np.ndarray:
    """The keys of the bands, all negative: lines x ``BANDS``."""
    return -1 - ((np.arange(BANDS, dtype=np.int64) << 32) + (keys.astype(np.int64) & 0xFFFFFFFF))


def all_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The keys of lines(print, sketch, keys), in four and ``BANDS`` columns."""
    return np.concatenate((block_keys(batch.column(0).to_numpy().view(np.uint64)), band_keys(of_width(batch.column(2), np.int32))), axis=1)


def place_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def slices_of(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of more than ``SLICE`` lines, in order, and into how many slices each is cut."""
    chunk = 1 << 14

    def counts(batches):
        total = np.zeros(1 << PLACE_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(place_of(all_keys(batch).ravel()), minlength=len(total))
        some = [k for k in range(len(total) // chunk) if total[k * chunk : (k + 1) * chunk].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(
                [total[k * chunk : (k + 1) * chunk].astype(np.uint32).tobytes() for k in some], pa.binary())], ["chunk", "n"])

    def large(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.uint32).astype(np.int64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(k * chunk + np.flatnonzero(n > SLICE), pa.int64())], ["place"])

    # Counted over hashes of keys first; few of these can hold a large key.
    places = lines.mapInArrow(counts, "chunk int, n binary").repartition("chunk").mapInArrow(large, "place long")
    places = np.array(sorted(r[0] for r in places.collect()), np.int64)  # at most 2^20
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def within(batches):
        for batch in batches:
            keys = all_keys(batch).ravel()
            keys, n = np.unique(keys[np.isin(place_of(keys), places)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    sizes = lines.mapInArrow(within, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > SLICE)
    sizes = sorted((r[0], -(-r[1] // SLICE)) for r in sizes.collect())  # few: each stands for SLICE rows
    return tuple(np.array(sizes, np.int64).reshape(-1, 2).T)


def entries(keys: np.ndarray, prints: np.ndarray, sketches: np.ndarray, ids: np.ndarray, chars: np.ndarray,
            hot: np.ndarray, slices: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of the shuffle, ``ENTRY``) of each line in each of its keys. A line with a key of several slices goes to every
    pair of slices that includes its own."""
    n, wide = keys.shape
    value = np.where(np.arange(wide) < 4, prints[:, None], sketches[:, None]).ravel()
    block = np.tile(np.where(np.arange(wide) < 4, np.uint64(BLOCK), np.uint64(0)), n)
    line, keys = np.repeat(np.arange(n), wide), keys.ravel()
    hash_ = mix(keys.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        many = np.where(hot[at] == keys, slices[at], 1)
        own = (mix(value + np.uint64(1)) % many.astype(np.uint64)).astype(np.int64)
        each = np.repeat(np.arange(len(keys)), many)
        other = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        own = own[each]
        met = np.minimum(own, other) * many[each] + np.maximum(own, other)
        hash_ = mix(hash_[each] + met.astype(np.uint64))
        block = block[each] | np.where(own != other, np.uint64(MIXED), np.uint64(0)) | (own > other).astype(np.uint64)
        value, line = value[each], line[each]
    part = ((hash_ >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(part.astype(np.uint16), kind="stable") if parts <= 1 << 16 else np.argsort(part, kind="stable")
    out = np.empty(len(order), ENTRY)
    out["key"] = ((hash_ & np.uint64(0xFFFFFFF8)) | block)[order]
    out["value"] = value[order]
    line = line[order]
    out["low"], out["high"] = (ids & 0xFFFFFFFF)[line], (ids >> 32)[line]
    out["chars"] = np.minimum(chars, 0xFFFF)[line]
    return part[order], out


def packed(lines: DataFrame, parts: int) -> DataFrame:
    """part int, entries binary: the entries of lines(print, sketch, keys, line, chars), by part."""
    hot, slices = slices_of(lines.select("print", "sketch", "keys"))

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table_ = pa.Table.from_batches(held).combine_chunks()
        prints, sketches = (table_.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        part, found = entries(all_keys(table_.to_batches()[0]), prints, sketches, ids_of(of_width(table_["line"], np.uint64)),
                              table_["chars"].to_numpy(), hot, slices, parts)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        where = (ENTRY.itemsize * np.concatenate((start, [len(part)]))).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(where), pa.py_buffer(found)])
        return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), blobs], ["part", "entries"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    return lines.select("print", "sketch", "keys", "line", "chars").mapInArrow(run, "part int, entries binary")


def whole_blocks(batches, rows: int = 1 << 14, size: int = 1 << 24):
    """Tables of about ``rows`` rows or ``size`` bytes, no (key, part) torn apart; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    n, weight = 0, 0
    for batch in batches:
        held.append(batch)
        n, weight = n + batch.num_rows, weight + batch.nbytes
        if n < rows and weight < size:
            continue
        all_ = pa.Table.from_batches(held)
        last = [all_.column(k)[-1].as_py() for k in range(2)]
        same = [np.asarray(all_.column(k)) == last[k] for k in range(2)]
        apart = np.flatnonzero(~(same[0] & same[1]))
        if len(apart):
            cut = int(apart[-1]) + 1
            yield all_.slice(0, cut).combine_chunks()
            all_ = all_.slice(cut)
        held = all_.to_batches()
        n, weight = all_.num_rows, all_.nbytes
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def slabs(batches, rows: int = 1 << 18):
    """(key of 64 bits, entry) in order of the key, about ``rows`` entries at a time, no part torn apart: the
    rows come sorted by part."""
    def sorted_(keys, found):
        key, found = np.concatenate(keys), np.concatenate(found)
        order = np.argsort(key)
        return key[order], found[order]

    keys, found, last, n = [], [], None, 0
    for batch in batches:
        part = batch.column(0).to_numpy()
        if not len(part):
            continue
        sizes = np.asarray(pc.binary_length(batch.column(1))) // ENTRY.itemsize
        _, where, data = batch.column(1).buffers()
        where = np.frombuffer(where, np.int32)[batch.column(1).offset :]
        all_ = np.frombuffer(data, np.uint8)[where[0] : where[len(part)]].view(ENTRY)
        key = np.repeat(part.astype(np.uint64), sizes) << np.uint64(32) | all_["key"]
        cut = 0
        for k in np.flatnonzero(np.concatenate(([part[0] != last], part[1:] != part[:-1]))):
            at = int(sizes[:k].sum())
            if n + at - cut >= rows:
                yield sorted_([*keys, key[cut:at]], [*found, all_[cut:at]])
                keys, found, n, cut = [], [], 0, at
        keys, found, n, last = [*keys, key[cut:]], [*found, all_[cut:]], n + len(key) - cut, part[-1]
    if n:
        yield sorted_(keys, found)


def shared_first(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` (without the side) is the first key of its kind in which the lines with these rows of keys (-1 where there is
    none) meet: of a pair of slices they must be of different ones."""
    meets = a[:, :, None] ^ ((a >> 1) & 1)[:, :, None] == b[:, None, :]
    meets &= ((a >= 0) & ((a ^ key[:, None]) & BLOCK == 0))[:, :, None]
    return np.where(meets.any(axis=2), a & ~np.int64(SIDE), np.int64(LAST)).min(axis=1) == key


def candidates(lines: DataFrame, bits: int, least: float) -> DataFrame:
    """block boolean, a, b, key_a, key_b, value_a, value_b, whole: pairs of ids (a <= b) with prints within ``bits`` of each
    other, or sketches within ``SKETCH_BITS``, and lengths that allow ``least``; of dense keys each line
    that has a partner, as a pair with itself and the key as ``whole``."""

    def run(batches):
        for key, slab in slabs(batches):
            values, n = slab["value"], len(slab)
            ids = slab["low"].astype(np.int64) | slab["high"].astype(np.int64) << 32
            chars, side = slab["chars"].astype(np.int64), key & np.uint64(SIDE)
            most = np.where(key & np.uint64(BLOCK) != 0, bits, SKETCH_BITS)
            of = key >> np.uint64(1)
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            size = np.diff(np.concatenate((start, [n])))
            group = np.repeat(np.arange(len(start)), size)
            mixed = (key & np.uint64(MIXED)) != 0
            hit, dense = np.zeros(n, bool), np.zeros(len(start), bool)
            pairs = [(np.zeros(0, np.int64),) * 2]

            def good(i, j):
                """Which of these are worth comparing: not of one slice where two meet, and of lengths near enough."""
                longer = np.maximum(chars[i], chars[j])
                return (np.abs(chars[i] - chars[j]) <= ((1 - least) * longer + 1e-9).astype(np.int64)) & ~(mixed[i] & (side[i] == side[j]))

            small = size <= SMALL_BLOCK
            at = np.flatnonzero(small[group] & (size[group] > 1))  # small blocks: each row with the one, two, ... rows after it
            step = 1
            while len(at):
                at = at[at + step < n]
                at = at[group[at] == group[at + step]]
                near = at[np.bitwise_count(values[at] ^ values[at + step]) <= most[at]]
                near = near[good(near, near + step)]
                pairs.append((near, near + step))
                step += 1
            for g in np.flatnonzero(~small):
                s, e = start[g], start[g] + size[g]
                order = s + np.argsort(gray_rank(values[s:e]))
                held, count = [], 0

                def found(i, j):
                    nonlocal count
                    i, j = order[i], order[j]
                    keep = good(i, j)
                    i, j = i[keep], j[keep]
                    hit[i] = hit[j] = True
                    count += len(i)
                    if count > DENSE * len(order):
                        dense[g] = True
                        held.clear()
                    else:
                        held.append((i, j))

                close(values[order], None, int(most[s]), found, lambda i, j: hit[order[i]] & hit[order[j]] & dense[g])
                pairs.extend(held)
            x, y = (np.concatenate(side_) for side_ in zip(*pairs))
            dense |= np.bincount(group[x], minlength=len(start)) > DENSE * size
            many = dense[group[x]]
            hit[x[many]] = hit[y[many]] = True
            x, y = x[~many], y[~many]
            alone = np.flatnonzero(hit & dense[group])
            turn = ids[x] > ids[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            x, y = np.concatenate((x, alone)), np.concatenate((y, alone))
            keys, prints = key.view(np.int64), values.view(np.int64)
            whole = np.concatenate((np.full(len(x) - len(alone), -1), keys[alone]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[x] & BLOCK != 0), *map(pa.array, (ids[x], ids[y], keys[x], keys[y], prints[x], prints[y], whole))],
                ["block", "a", "b", "key_a", "key_b", "value_a", "value_b", "whole"])

    spark = lines.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(lines, parts).repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "block boolean, a long, b long, key_a long, key_b long, value_a long, value_b long, whole long")


def meeting(found: DataFrame) -> DataFrame:
    """key, value, id: where the texts of ``candidates`` meet; a pair only in its lowest block or band."""
    pairs = found.groupBy("block", "a", "b", "whole").agg(
        *[F.min(c).alias(c) for c in ("key_a", "key_b", "value_a", "value_b")])  # both keys differ in the side only
    ends = F.array(*[F.struct(F.col(f"key_{x}").alias("key"), F.col(f"value_{x}").alias("value"), F.col(x).alias("id")) for x in "ab"])
    return pairs.select(F.explode(ends).alias("end")).select("end.*").distinct()


def least_in_column(up: np.ndarray, down: np.ndarray, column: int, ahead: np.ndarray) -> np.ndarray:
    """What the distance of each pair is at least, from the differences in a column (bytes of eight rows): the least
    sum of a cell and of what the lengths left differ by. Each eighth row is looked at; the others are at most eight
    less. ``ahead``: how much more is left in row 0 of the text along the rows."""
    cells = np.zeros((len(up), up.shape[1] + 1), np.int32)
    np.cumsum(np.bitwise_count(up).astype(np.int32) - np.bitwise_count(down), axis=1, out=cells[:, 1:])
    left = ahead[:, None] - 8 * np.arange(cells.shape[1])
    return (cells + np.abs(left)).min(axis=1) + column - 8


def edit_distance(a: str | list[str], b: str | list[str], most: int) -> int:
    """Levenshtein distance of texts or lists of words, or some number above ``most``; bit-parallel, a column at a time."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    s = next((k for k in range(n) if a[k] != b[k]), n)
    e = next((k for k in range(n - s) if a[-1 - k] != b[-1 - k]), n - s)
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    masks: dict[str, int] = {}
    for k, c in enumerate(b):
        masks[c] = masks.get(c, 0) | (1 << k)
    last, full = 1 << (len(b) - 1), (1 << len(b)) - 1
    up, down, score = full, 0, len(b)
    for k, c in enumerate(a):
        m = masks.get(c, 0)
        d0 = (((m & up) + up) ^ up) | m | down
        hp, hn = down | ~(d0 | up) & full, up & d0
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        if score - (len(a) - 1 - k) > most:
            return most + 1
        hp, hn = (hp << 1 | 1) & full, (hn << 1) & full
        up, down = hn | ~(d0 | hp) & full, hp & d0
        if k % LOOK == LOOK - 1 and len(b) >= LOOK:
            sides = (np.frombuffer(x.to_bytes(-(-len(b) // 8), "little"), np.uint8)[None] for x in (up, down))
            if least_in_column(*sides, k + 1, np.array([len(b) - len(a) + k + 1]))[0] > most:
                return most + 1
    return score


def one_for_one(x: list[str], y: list[str], most: int) -> bool:
    """Whether writing the words of ``y`` over those of ``x`` that differ is within ``most``."""
    return len(x) == len(y) and sum([max(len(v), len(w)) for v, w in zip(x, y) if v != w]) <= most


def similar(a: str, b: str, least: float) -> bool:
    """1 - edit distance / longer length >= ``least``. Edits that touch few words are seen from the words:
    replacing whole words is a way to edit, so the distance is at most what that costs."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if one_for_one(x, y, most):
        return True
    longest = max(map(len, x + y)) + 1  # with the space of a word that is only in one
    if edit_distance(x, y, most // longest) * longest <= most:
        return True
    return edit_distance(a, b, most) <= most


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of all texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def near_enough(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``, all pairs a column at a time.

    The vertical differences of a column are kept as bits, 64 rows of the matrix in a word; where a character
    is in the first text is looked up in a table of such words. Only words that
    meet the band around the diagonal are advanced; the others stand for rows beyond any distance asked for.
    Pairs whose second text has ended are left as they are; the differences then add up to the distance. Pairs
    of which a column says that they end beyond ``most`` are dropped on the way. The band: whoever is on the
    diagonal x (rows less columns) and ends on the diagonal d has paid abs(x) and pays abs(d - x).
    """
    a, b = zip(*[(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]) if len(a) else ((), ())
    out = np.zeros(len(a), bool)
    ends = np.array([len(y) for y in b])
    order = np.argsort(-ends, kind="stable")
    ends, rows, most = ends[order], np.array([len(a[k]) for k in order]), most[order]
    words = max(1, -(-int(rows.max(initial=0)) // 64))
    above, below = int((most - rows + ends).max(initial=0)) // 2, int((most + rows - ends).max(initial=0)) // 2
    codes, others = codes_of([a[k] for k in order]), codes_of([b[k] for k in order])
    number = np.zeros(1 + max(codes.max(initial=0), others.max(initial=0)), np.int64)
    number[codes] = 1
    signs = np.flatnonzero(number)
    number[signs] = np.arange(1, len(signs) + 1)
    if len(order) > 1 and words * len(order) * (len(signs) + 1) > TABLE:
        for half in (slice(0, len(order) // 2), slice(len(order) // 2, None)):
            out[order[half]] = near_enough([a[k] for k in order[half]], [b[k] for k in order[half]], most[half])
        return out
    n = len(order)
    one, top = np.uint64(1), np.uint64(63)
    # Place n * k + i of word w: where the sign k is in the first text of the pair i. Sign 0 is in none.
    table_ = np.zeros((words, (len(signs) + 1) * n), np.uint64)
    pair = np.repeat(np.arange(n), rows)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(rows) - rows, rows)
    np.add.at(table_.reshape(-1), (at >> 6) * table_.shape[1] + number[codes] * n + pair,
              one << (at & 63).astype(np.uint64))
    pair = np.repeat(np.arange(n), ends)
    right = np.zeros((int(ends.max(initial=0)), n), np.int64)
    right[np.arange(len(others)) - np.repeat(np.cumsum(ends) - ends, ends), pair] = number[others] * n + pair
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    for column in range(len(right)):
        n = int(np.searchsorted(-ends, -column))  # pairs whose second text goes on
        if column % LOOK == 0 and column and n:
            good = np.ones(len(ends), bool)
            sides = (np.ascontiguousarray(x[:, :n].T).view(np.uint8) for x in (up, down))
            good[:n] = least_in_column(*sides, column, (rows - ends)[:n] + column) <= most[:n]
            if 4 * good.sum() < 3 * len(good):
                order, ends, rows, most = order[good], ends[good], rows[good], most[good]
                up, down = up[:, good], down[:, good]
                right = right[:, good]
                n = int(good[:n].sum())
        if not n:
            break
        rises, falls = one, np.uint64(0)
        signs_at = right[column, :n]
        for w in range(max(0, (column - above) // 64), min(words, (column + below) // 64 + 1)):
            equal = table_[w].take(signs_at)
            p, m = up[w, :n], down[w, :n]
            vertical = equal | m
            equal |= falls
            across = equal & p
            across += p
            across ^= p
            across |= equal
            fall = p & across
            across |= p
            rise = np.invert(across, out=across)
            rise |= m
            carry = rise >> top, fall >> top
            rise += rise
            rise |= rises
            fall += fall
            fall |= falls
            rises, falls = carry
            np.bitwise_and(rise, vertical, out=m)
            vertical |= rise
            np.invert(vertical, out=vertical)
            np.bitwise_or(fall, vertical, out=p)
    distance = ends.copy()
    for w in range(words):
        bits = np.clip(rows - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (one << (bits & top)) - one)
        distance += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask)
    out[order] = distance <= most
    return out


def similar_pairs(a: list[str], b: list[str], least: float) -> np.ndarray:
    """``similar`` of each pair. Very long texts, and those of few pairs, go one by one; the others after a look
    whether replacing words one for one is enough."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    longer = sizes.max(axis=1)
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= most)
    out[todo] = [one_for_one(a[k].split(" "), b[k].split(" "), m) for k, m in zip(todo.tolist(), most[todo].tolist())]
    todo = todo[~out[todo]]
    todo = todo[np.argsort(longer[todo], kind="stable")]

    def look(todo, most, first):
        while len(todo):
            take = max(1, int(np.searchsorted(longer[todo] * np.arange(1, len(todo) + 1), TOGETHER, "right")))
            part, todo = todo[:take], todo[take:]
            if take >= ALONE + longer[part[-1]] // 16:
                out[part] = near_enough([a[k] for k in part], [b[k] for k in part], most[part])
            elif not first:
                out[part] = [similar(a[k], b[k], least) for k in part]

    near = most // 4
    look(todo[(longer[todo] >= LONG) & (np.abs(sizes[todo, 0] - sizes[todo, 1]) <= near[todo])], near, True)
    look(todo[~out[todo]], most, False)
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs join two sets that those before them leave apart."""
    of: dict[int, int] = {}

    def top(x):
        while (y := of.get(x, x)) != x:
            of[x] = x = of.get(y, y)
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            of[y] = x
            out[k] = True
    return out


def verified(rows: DataFrame, bits: int, least: float) -> DataFrame:
    """Edges (a, b) of a forest of the linked lines of ``rows(key, value, line, keys, norm)``; ``keys`` are all keys
    of the line in ``rows``: two lines are compared in one block and in one band."""

    def edges(block: pa.Table):
        met, key, prints = (np.asarray(block.column(k)) for k in (0, 2, 3))
        values, n = prints.view(np.uint64), len(key)
        coded = block.column(4).combine_chunks().dictionary_encode()
        line, lines = np.asarray(coded.indices), coded.dictionary
        texts, lists = block.column(6), block.column(5).combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        keys = np.full((n, int(sizes.max(initial=1))), -1, np.int64)
        keys[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
        chars = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        wide = wide_sketches(texts.take(pa.array(np.unique(line, return_index=True)[1])).to_pylist())
        sets, far = Forest(len(lines)), [(np.zeros(0, np.int64),) * 2]
        start = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
        size = np.diff(np.concatenate((start, [n])))
        group = np.repeat(np.arange(len(start)), size)
        most = np.where(key & BLOCK != 0, bits, SKETCH_BITS)

        pending: list = []
        waiting = 0

        def compare(all_: bool = False):
            """What is pending, if it is enough to be worked on together. The most alike first: others become connected."""
            nonlocal waiting
            if not waiting or not all_ and waiting < 4 * PAIRS:
                return
            i, j = (np.concatenate(side) for side in zip(*pending))
            pending.clear()
            waiting = 0
            alike = np.argsort(np.bitwise_count(values[i] ^ values[j]), kind="stable")
            i, j = i[alike], j[alike]
            for turn in range(3):  # twice those that would do if all were similar, then all that are still apart
                apart = sets.of[line[i]] != sets.of[line[j]]
                i, j = i[apart], j[apart]
                now = spanning(sets.of[line[i]], sets.of[line[j]]) if turn < 2 else np.ones(len(i), bool)
                x, y = i[now], j[now]
                good = similar_pairs(*([texts[int(k)].as_py() for k in side] for side in (x, y)), least)
                far.append((line[x[good]], line[y[good]]))
                sets.unite(*far[-1])
                i, j = i[~now], j[~now]

        def check(i, j):
            nonlocal waiting
            longer = np.maximum(chars[i], chars[j])
            keep = np.abs(chars[i] - chars[j]) <= ((1 - least) * longer + 1e-9).astype(np.int64)
            keep &= (key[i] & MIXED == 0) | (key[i] != key[j])  # pairs of one slice only count where it meets itself
            i, j = i[keep], j[keep]
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                keep = np.bitwise_count(wide[line[x]] ^ wide[line[y]]).sum(axis=1) <= WIDE_BITS
                keep |= key[x] & BLOCK != 0
                x, y = x[keep], y[keep]
                keep = shared_first(keys[x], keys[y], key[x] & ~np.int64(SIDE))
                if keep.any():
                    pending.append((x[keep], y[keep]))
                    waiting += len(pending[-1][0])
            compare()

        small = size <= SMALL_BLOCK
        at, step = np.flatnonzero(small[group]), 1  # each row with the one, two, ... rows after it
        while len(at):
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            near = at[np.bitwise_count(values[at] ^ values[at + step]) <= most[at]]
            near = near[sets.of[line[near]] != sets.of[line[near + step]]]
            check(near, near + step)
            step += 1
        for g in np.flatnonzero(~small):
            order = start[g] + np.argsort(gray_rank(values[start[g] : start[g] + size[g]]), kind="stable")
            close(values[order], None, int(most[start[g]]),
                  lambda i, j: check(order[i], order[j]), lambda i, j: sets.of[line[order[i]]] == sets.of[line[order[j]]])
        compare(True)
        a, b = (np.concatenate(side) for side in zip(*far))
        return pa.RecordBatch.from_arrays([lines.take(pa.array(side)) for side in (a, b)], ["a", "b"])

    def run(batches):
        for block in whole_blocks(batches):
            yield edges(block)

    rows = rows.select(F.shiftright("key", 1).alias("met"), F.lit(0).alias("part"), "key", "value", "line", "keys", "norm")
    return rows.repartition("met").sortWithinPartitions("met").mapInArrow(run, "a binary, b binary")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines with the distinct ids of ``wanted``: its columns, ``line`` and the text as ``norm``.

    The documents pass once more and yield the lines whose id is marked in a bit table of fixed
    size; a join on the ids then drops those marked by chance.
    """
    place = F.shiftright("id", 48 - TABLE_BITS)
    marks = wanted.groupBy(F.shiftright(place, 15).alias("at")).agg(
        F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    table_ = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for at, bits in marks.collect():  # at most 2^9 rows of 4 KiB
        table_[at << 12 : (at + 1) << 12] = np.frombuffer(bytes(bits), np.uint8)

    def run(batches):
        for batch in batches:
            found: dict[bytes, str] = {}
            for text in batch.column(0).to_pylist():
                for line in normalised(text or "").split("\n"):
                    if len(line) >= MIN_CHARS:
                        digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        bit = int.from_bytes(digest[:6], "little") >> 48 - TABLE_BITS
                        if table_[bit >> 3] >> (bit & 7) & 1:
                            found[digest] = line
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(x[:6], "little") for x in found], pa.int64()),
                pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], ["id", "line", "norm"])

    texts = docs.select("text").mapInArrow(run, "id long, line binary, norm string")
    return texts.join(wanted, "id").groupBy("line").agg(*[F.first(c).alias(c) for c in ("norm", *wanted.columns)])


def removals(docs: DataFrame, bits: int = BITS, least: float = SIMILAR) -> DataFrame:
    """doc (null id as the largest), row (hash of the text), gone array<int>: numbers of the lines that go."""
    all_ = written(occurrences(docs), "lines")
    distinct = written(distinct_lines(all_), "distinct-lines")
    found = candidates(distinct.where("print is not null"), bits, least)
    meet = written(meeting(found), "near-lines")
    wanted = meet.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most one of each block and band and pair of slices
    texts = written(texts_of(written(wanted, "near-ids"), docs), "near-texts")
    groups = components(verified(meet.join(texts, "id"), bits, least), "line-links")
    groups = groups.select(F.col("id").alias("line"), "component")
    # Lines that occur once and are linked to none are no longer looked at.
    some = distinct.select("line", "doc", "row", "nth", "n").join(groups, "line", "left").where("n > 1 or component is not null")
    some = written(some.withColumn("component", F.coalesce("component", "line")), "grouped-lines")
    first = some.groupBy("component").agg(F.min(F.struct("doc", "row", "nth")).alias("first"))
    first = written(first, "first-of-group")  # the join then sees plain exchanges, whose hot keys are split
    some = written(some.join(first, "component").select("line", "first"), "first-lines")
    gone = all_.select("line", "doc", "row", "nth").join(some, "line").where(F.struct("doc", "row", "nth") != F.col("first"))
    return gone.groupBy("doc", "row").agg(F.collect_set("nth").alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda _, k: ~F.array_contains(gone, k))
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))


def all_taking_part(text: Column) -> Column:
    """Numbers of the lines of a text that take part, null where there are none."""

    @F.pandas_udf("array<int>")
    def numbers(texts: pd.Series) -> pd.Series:
        found = [[k for k, x in enumerate(normalised(t).split("\n")) if takes_part(x)] if t else [] for t in texts]
        return pd.Series([f or None for f in found])

    return numbers(text)


def cleaned(docs: DataFrame, bits: int = BITS, least: float = SIMILAR) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, and ``_gone`` (their numbers or null)."""
    gone = written(removals(docs, bits, least), "gone-lines").select(
        F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_hash", row_hash())
    copy = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_hash"))
    keyed = keyed.withColumn("_copy", copy)
    # The removals grow with the corpus: never broadcast, the same plan at every size.
    on = (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_row"))
    found = keyed.join(gone.hint("merge"), on, "left").drop("_doc", "_row")
    again = F.col("_copy") > 1
    # Python sees the text of further copies only; of the others it gets null.
    found = found.withColumn("_all", all_taking_part(F.when(again, F.col("text"))))
    found = found.withColumn("_gone", F.when(again, F.col("_all")).otherwise(F.col("_gone")))
    return found.withColumn("text", without(F.col("text"), F.col("_gone"))).select(*docs.columns, "_gone")


def deduplicated(docs: DataFrame, bits: int = BITS, least: float = SIMILAR) -> DataFrame:
    """``docs`` with its columns; ``n_chars``, where there is one, follows the text."""
    apart, restored = set_aside(docs, "_gone", "_doc", "_row", "_key", "_hash", "_copy", "_all")
    found = cleaned(apart, bits, least).drop("_gone")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)))
    return found.select(restored(found))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    found = cleaned(docs.withColumn("n_lines", lines.cast("long")))
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
