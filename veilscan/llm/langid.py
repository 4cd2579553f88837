"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed byte n-grams tells
the languages with that bit from the others: its weights are log ratios of the n-gram shares of
both sides, each language counting alike. A text's mean weight per n-gram is the bit's margin.
Decoding takes the codeword with the smallest loss, bits weighted by their reliability; a text is
ambiguous when the two best codewords are nearly as good.

The classifiers are fitted on at most ``max_train`` labelled documents of each language (chosen
by a hash of the id). Everything else runs over whole texts of all rows, without a shuffle.

Defined results: null text or text without a letter is ``und`` with score 0, as is every text
when nothing was learned; with one learned language all other texts get it with score 1; ties go
to the language that sorts first; a null id is neither held out nor learned from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from veilscan.llm.tables import set_aside, table
from veilscan.llm.words import LOWER, mix, pieces
from veilscan.session import ship_by_value

ship_by_value(__name__)

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
MAX_TRAIN = 4000

#: Lower case; digits alike; white space alike.
FOLD = LOWER.copy()
FOLD[48:58] = 48
FOLD[[9, 10, 11, 12, 13]] = 32


def n_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the ``size`` bytes from each byte on; the last ones of the buffer are left out."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key << np.uint64(8)) | data[k : k + n]
    return (mix(key + np.uint64(size << 40)) % np.uint64(BUCKETS)).astype(np.int64)


def inside(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the range of its n-grams among those of the buffer."""
    return offsets[:-1], np.maximum(offsets[1:] - size + 1, offsets[:-1])


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """languages x bits of +1/-1: all splits for up to 5 languages, else the best of random codes."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, best, widest = np.random.default_rng(seed), None, -1
    bits = max(15, 8 * math.ceil(math.log2(languages)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        between = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 9999 * np.eye(languages, dtype=int)
        if between.min() > widest:
            best, widest = code, between.min()
    return best


def counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """n-gram counts, languages x buckets, of ``docs(lang, text)``: summed in the tasks first."""
    place = {name: k for k, name in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            langs = [place[x] for x in batch.column(0).to_pylist()]
            for row, end, data, offsets in pieces(batch.column(1)):
                data = FOLD[data]
                for size in SIZES:
                    key, (start, stop) = n_grams(data, size), inside(offsets, size)
                    for k in range(end - row):
                        total[langs[row + k]] += np.bincount(key[start[k] : stop[k]], minlength=BUCKETS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], ["lang", "bucket", "n"])

    found = docs.mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = found.toPandas()  # at most languages x BUCKETS rows
    total = np.zeros((len(place), BUCKETS))
    total[found["lang"], found["bucket"]] = found["n"]
    return total


class Model:
    """Codewords, bit classifiers (buckets x bits) and the bits' scale and reliability."""

    def __init__(self, languages: list[str], total: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True) if len(languages) else total
        sides = [np.log(share[side > 0].mean(axis=0) / share[side < 0].mean(axis=0)) for side in self.code.T]
        self.weights = np.stack(sides, axis=1).astype(np.float32) if sides else np.zeros((BUCKETS, 0), np.float32)
        self.scale = np.ones(self.code.shape[1])
        self.reliability = np.ones(self.code.shape[1])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight per n-gram: texts x bits."""
        n, bits = len(offsets) - 1, self.code.shape[1]
        sums, count = np.zeros((n, bits)), np.zeros(n)
        data = FOLD[data]
        for size in SIZES:
            key, (start, stop) = n_grams(data, size), inside(offsets, size)
            if not len(key):
                continue
            for b in range(bits):
                upto = np.concatenate(([0], np.cumsum(self.weights[key, b], dtype=np.float64)))
                sums[:, b] += upto[np.minimum(stop, len(key))] - upto[np.minimum(start, len(key))]
            count += stop - start
        return sums / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its share of exp(-loss), gap of loss per bit to the next one)."""
        z = margins * self.scale
        loss = np.zeros((len(z), len(self.languages)))
        for b, side in enumerate(self.code.T):
            loss += self.reliability[b] * np.logaddexp(0, -z[:, b][:, None] * side[None, :])
        best = loss.argmin(axis=1)
        low = loss[np.arange(len(z)), best]
        score = 1 / np.exp(np.clip(low[:, None] - loss, -60, 0)).sum(axis=1)
        ordered = np.sort(loss, axis=1)
        bits = max(self.reliability.sum(), 1e-9)
        gap = (ordered[:, 1] - ordered[:, 0]) / bits if loss.shape[1] > 1 else np.full(len(z), np.inf)
        return best, score, gap

    def calibrate(self, docs: DataFrame) -> None:
        """Scale (margins of about 4) and reliability of each bit, over ``docs(lang, text)``."""
        place = {name: k for k, name in enumerate(self.languages)}

        def run(batches):
            for batch in batches:
                langs = np.array([place[x] for x in batch.column(0).to_pylist()], int)
                for row, end, data, offsets in pieces(batch.column(1)):
                    signed = self.margins(data, offsets) * self.code[langs[row:end]]
                    for b in range(signed.shape[1]):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([b]), pa.array([end - row]), pa.array([float(np.abs(signed[:, b]).sum())]),
                            pa.array([int((signed[:, b] <= 0).sum())])], ["bit", "n", "size", "wrong"])

        rows = docs.mapInArrow(run, "bit long, n long, size double, wrong long").groupBy("bit").agg(
            F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("wrong").alias("wrong")).collect()
        for r in rows:
            self.scale[r["bit"]] = 4 / max(r["size"] / r["n"], 1e-9)
            error = (r["wrong"] + 1) / (r["n"] + 2)
            self.reliability[r["bit"]] = max(math.log((1 - error) / error), 0.05)
        self.reliability /= max(self.reliability.mean(), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled documents that are not held out.

    Of each language at most about ``max_train`` documents are read: those whose hashed id lies
    below the share that this number is of the language's documents.
    """
    open_ = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    open_ = open_.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.lit(1.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, max_train / sizes[name])).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = open_.where(place < share).select("lang", "text")
    model = Model(languages, counts(chosen, languages))
    if len(languages) > 1:
        model.calibrate(chosen)
    return model


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model, ambiguous: float = 0.02) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous (replacing columns of these names)."""
    docs = docs.drop("lang_pred", "score", "ambiguous")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            n = batch.num_rows
            names, scores, flags = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            lettered = np.fromiter((has_letter(t.as_py()) for t in column), bool, n)
            for row, end, data, offsets in pieces(column):
                if not model.languages:
                    continue
                if len(model.languages) == 1:
                    names[row:end], scores[row:end] = model.languages[0], 1.0
                else:
                    best, score, gap = model.decode(model.margins(data, offsets))
                    names[row:end], scores[row:end] = np.array(model.languages, object)[best], score
                    flags[row:end] = gap < ambiguous
            names[~lettered], scores[~lettered], flags[~lettered] = "und", 0.0, False
            more = [pa.array(names, pa.string()), pa.array(scores), pa.array(flags)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents in a learned language: ``und`` and ambiguous ones go. Same columns, with their values."""
    apart, restored = set_aside(docs, "lang_pred", "score", "ambiguous")
    found = identify(apart, model or fit(docs))
    found = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return found.select(restored(found))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
