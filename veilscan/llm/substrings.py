"""Substring deduplication: repeated passages are located by Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. Every word goes that lies in a window whose words also
start somewhere in a document with a smaller id.

1. One pass hashes every text's 25-word grams and keeps the least of each 26 neighbours as
   anchors. Equal windows have equal anchors, so only anchors of two documents matter. Texts
   with equal word sequences count as one; all but the first of them repeat it from end to end.
2. For windows that hold such an anchor, the smallest document is found per window hash. Windows
   of two documents are confirmed; they make up the passages of their first document.
3. Passages are dealt into shards by their first document. A document is sent to the shards that
   hold one of its anchors; shards that many documents need are dealt over several tasks.
4. A task compiles its passages' aligned 25-word blocks into one automaton and streams its
   documents through. The windows of the text around a hit are looked up among those of the
   passages, each of which knows its first owner, and compared by their words; hashes only choose
   where to look. Each window of a passage holds an aligned block, so none is missed, and a
   passage that all documents hold costs each of them once, whatever it is surrounded by.

64-bit window hashes could hide a repeat only if two different windows that hold recurring
anchors share a hash; equal hashes never remove anything by themselves.

Defined results: null text has no words; documents with fewer than ``WINDOW`` words stay whole;
rows with equal ids do not shorten each other; null ids stay whole and shorten none; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.tables import table, written
from veilscan.llm.words import Words, pieces
from veilscan.session import ship_by_value

ship_by_value(__name__)

WINDOW = 50
ANCHOR = WINDOW // 2
NEIGHBOURS = WINDOW - ANCHOR + 1
SHARD_WORDS = 200_000
SLICE_WORDS = 4_000_000


def sliding(values: np.ndarray, size: int, of) -> np.ndarray:
    """Least or greatest of each ``size`` neighbours, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Marks the grams that are the least of some ``NEIGHBOURS`` good neighbours."""
    if len(grams) < NEIGHBOURS:
        return np.zeros(len(grams), bool)
    whole = sliding(good.astype(np.uint8), NEIGHBOURS, np.minimum).astype(bool)
    least = np.where(whole, sliding(grams, NEIGHBOURS, np.minimum), np.uint64(0))
    edge = np.zeros(NEIGHBOURS - 1, np.uint64)
    return good & (grams > 0) & (sliding(np.concatenate((edge, least, edge)), NEIGHBOURS, np.maximum) == grams)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by one space), anchors: one row per input row."""

    def run(batches):
        for batch in batches:
            shas, numbers, lists = [], [], []
            for _, _, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                grams, good = words.grams(words.hashes(), ANCHOR)
                at = np.flatnonzero(anchors(grams, good))
                cuts = np.searchsorted(at, words.first)
                for k in range(len(offsets) - 1):
                    own = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
                    numbers.append(len(own))
                    lists.append(np.unique(grams[at[cuts[k] : cuts[k + 1]]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "anchors"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_words long, sha string, anchors array<long>")


def with_anchors(docs: DataFrame, recurring: DataFrame) -> DataFrame:
    """doc_id, sha, text, anchors of the documents that hold a recurring anchor."""
    lists = recurring.groupBy("doc_id", "sha").agg(F.collect_list("anchor").alias("anchors"))

    def run(batches):
        for batch in batches:
            # Rows may share an id: only the text that the anchors came from is meant.
            texts = batch.column(1).to_pylist()
            own = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
            same = [a == b for a, b in zip(own, batch.column(2).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = slim.join(lists, "doc_id").select("doc_id", "text", "sha", "anchors")
    return joined.mapInArrow(run, joined.schema)


def window_hashes(active: DataFrame) -> DataFrame:
    """window, doc_id: the windows of each document that hold one of its recurring anchors."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2)
            for first, end, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                h = words.hashes()
                (grams, _), (windows, whole) = words.grams(h, ANCHOR), words.grams(h, WINDOW)
                for k in range(end - first):
                    low, high = words.first[k], words.first[k + 1]
                    known = lists[first + k].values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(grams[low:high], known))
                    marks = np.zeros(high - low + 1, np.int64)
                    np.add.at(marks, np.maximum(at - (NEIGHBOURS - 1), 0), 1)
                    np.add.at(marks, at + 1, -1)
                    keep = (np.cumsum(marks)[:-1] > 0) & whole[low:high]
                    found = np.unique(windows[low:high][keep]).view(np.int64)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found), pa.array(np.full(len(found), ids[first + k]))], ["window", "doc_id"])

    return active.select("doc_id", "text", "anchors").mapInArrow(run, "window long, doc_id long")


def passages(active: DataFrame, shared: DataFrame) -> DataFrame:
    """owner, words, n_words, anchors: the confirmed windows ``shared(window, first)`` of each
    first document, merged where they overlap. Of equal windows in a document the first counts."""
    lists = shared.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("window").alias("windows"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            out: list = []
            for first, end, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                h = words.hashes()
                (grams, good), (windows, whole) = words.grams(h, ANCHOR), words.grams(h, WINDOW)
                chosen = anchors(grams, good)
                for k in range(end - first):
                    low, high = words.first[k], words.first[k + 1]
                    own = windows[low:high]
                    at = np.flatnonzero(whole[low:high] & np.isin(own, lists[first + k].values.to_numpy().view(np.uint64)))
                    at = np.sort(at[np.unique(own[at], return_index=True)[1]])
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > WINDOW) + 1) if len(at) else []:
                        s, e = low + run_[0], low + run_[-1] + WINDOW
                        inside = s + np.flatnonzero(chosen[s : e - ANCHOR + 1])
                        out.append((ids[first + k], b" ".join(words.word(w) for w in range(s, e)).decode(), e - s,
                                    np.unique(grams[inside]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                ["owner", "words", "n_words", "anchors"])

    joined = active.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "windows")
    return joined.mapInArrow(run, "owner long, words string, n_words long, anchors array<long>")


#: A word of a shard is three characters, each from a range of its own: nodes of the automaton have
#: few children, and nothing matches across the border of a word.
DIGIT = 128
STARTS = (0x1000, 0x2000, 0x3000)


def coded(number: int) -> str:
    return chr(STARTS[0] + number // DIGIT**2) + chr(STARTS[1] + number // DIGIT % DIGIT) + chr(STARTS[2] + number % DIGIT)


class Shard:
    """Passages of one shard, the automaton over their aligned blocks, and the least owner of each of their
    windows. A hit of the automaton says which windows of a text to look up; however many owners a block
    has, a window of the text is looked up once and its words compared with those of one passage."""

    UNKNOWN = coded(0)

    def __init__(self):
        self.vocabulary: dict[bytes, str] = {}
        self.passages: list[tuple[int, str]] = []
        self.windows: dict[int, list[tuple[int, int]]] = {}
        self.automaton = None

    def add(self, owner: int, words: str) -> None:
        v = self.vocabulary
        own = words.encode().split()
        for w in own:
            if w not in v:
                v[w] = coded(len(v) + 1)
        self.passages.append((owner, "".join([v[w] for w in own])))

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.passages.sort(key=lambda p: p[0])  # the first to bring a window is its least owner
        blocks = set()
        for p, (_, code) in enumerate(self.passages):
            size = len(code) // 3
            blocks.update(code[3 * at : 3 * (at + ANCHOR)] for at in range(0, size - ANCHOR + 1, ANCHOR))
            for at in range(size - WINDOW + 1):
                words = code[3 * at : 3 * (at + WINDOW)]
                spots = self.windows.setdefault(hash(words), [])
                if all(self.window(spot) != words for spot in spots):  # one spot, but for equal hashes
                    spots.append((p, at))
        for block in blocks:
            self.automaton.add_word(block, 1)
        self.automaton.make_automaton()

    def window(self, spot: tuple[int, int]) -> str:
        return self.passages[spot[0]][1][3 * spot[1] : 3 * (spot[1] + WINDOW)]

    def repeats(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Ranges of words that lie in windows of a passage of an earlier document."""
        v, unknown = self.vocabulary, self.UNKNOWN
        code = "".join([v.get(w, unknown) for w in text.encode().split()])
        size = len(code) // 3
        if size < WINDOW or not self.windows:
            return []
        out: list[list[int]] = []
        done = 0  # windows before this one have been looked up
        for end, _ in self.automaton.iter(code):
            stop = (end + 1) // 3
            for at in range(max(done, stop - WINDOW), min(stop - ANCHOR, size - WINDOW) + 1):
                words = code[3 * at : 3 * (at + WINDOW)]
                for spot in self.windows.get(hash(words), ()):
                    if self.passages[spot[0]][0] < doc_id and self.window(spot) == words:
                        if out and at <= out[-1][1]:
                            out[-1][1] = at + WINDOW
                        else:
                            out.append([at, at + WINDOW])
            done = max(done, min(stop - ANCHOR, size - WINDOW) + 1)
        return [tuple(r) for r in out]


def located(shards: DataFrame, routed: DataFrame) -> DataFrame:
    """doc_id, sha, ranges: what each shard finds in the documents that are sent to it.

    ``shards(shard, slice, owner, words)``, ``routed(shard, slice, doc_id, sha, text)``.
    """
    both = shards.select("shard", "slice", F.lit(0).alias("kind"), F.col("owner").alias("id"), F.lit("").alias("sha"),
                         F.col("words").alias("text")).union(
        routed.select("shard", "slice", F.lit(1), "doc_id", "sha", "text"))

    def run(batches):
        name, shard = None, Shard()
        for batch in batches:
            out = []
            for at, slice_, kind, id_, sha, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (at, slice_) != name:
                    name, shard = (at, slice_), Shard()
                if kind == 0:
                    shard.add(id_, text)
                    continue
                if shard.automaton is None:
                    shard.compile()
                ranges = shard.repeats(id_, text or "")
                if ranges:
                    out.append((id_, sha, [x for r in ranges for x in r]))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["doc_id", "sha", "ranges"])

    dealt = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    return dealt.mapInArrow(run, "doc_id long, sha string, ranges array<long>")


def cut(active: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, sha, n_removed, kept_sha256 of the documents that lose words."""
    lists = ranges.groupBy("doc_id", "sha").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = (text or "").encode().split()
                marks = np.zeros(len(words) + 1, np.int64)
                pairs = ranges.values.to_numpy().reshape(-1, 2)
                np.add.at(marks, pairs[:, 0], 1)
                np.add.at(marks, pairs[:, 1], -1)
                stays = np.cumsum(marks)[:-1] == 0
                removed.append(int((~stays).sum()))
                kept.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(stays))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "sha", "n_removed", "kept_sha256"])

    joined = active.select("doc_id", "sha", "text").join(lists, ["doc_id", "sha"])
    joined = joined.select("doc_id", "sha", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, sha string, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "sha"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    all_ = written(scanned(docs), "scanned")
    firsts = written(all_.groupBy("sha").agg(F.min("doc_id").alias("first_of_sha")), "firsts")
    first = all_.where("doc_id is not null").join(firsts, "sha").where("doc_id = first_of_sha")
    spots = written(first.select("doc_id", "sha", F.explode("anchors").alias("anchor")), "anchors")
    common = spots.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    common = written(common.where("low < high").select("anchor"), "common-anchors")
    spots = written(spots.join(common, "anchor").select("doc_id", "sha", "anchor"), "recurring")
    active = written(with_anchors(docs, spots), "active")
    shared = window_hashes(active).groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = shared.where("first < last").select("window", "first")
    found = written(passages(active, shared), "passages")
    total = found.agg(F.sum("n_words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("int")
    found = found.withColumn("shard", shard)
    ways = found.select(F.explode("anchors").alias("anchor"), "shard").distinct()
    routes = written(spots.join(ways, "anchor").select("doc_id", "sha", "shard").distinct(), "routes")
    loads = routes.join(all_.select("doc_id", "sha", "n_words").distinct(), ["doc_id", "sha"]).groupBy("shard").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n_words") / SLICE_WORDS)).cast("int").alias("slices"))
    loads = written(loads, "loads")  # one row per shard
    routed = routes.join(loads, "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    routed = routed.join(active.select("doc_id", "sha", "text"), ["doc_id", "sha"])
    shards = found.join(loads, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cuts = written(cut(active, written(located(shards, routed), "ranges")), "cuts")
    copy = (F.col("doc_id") > F.col("first_of_sha")) & (F.col("n_words") >= WINDOW)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return all_.select("doc_id", "n_words", "sha").join(firsts, "sha").join(cuts, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def query(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents"))
