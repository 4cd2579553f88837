"""Importance resampling and exact top-k search, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from conftest import EDGES, LOWER_AZ, prose

from veilscan.llm import resampling, topk

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text):
    words = RUN.findall((text or "").translate(LOWER_AZ))
    return len(words), [crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def expected_scores(rows, target, share=25):
    docs = [(i, *features_of(t)) for i, t in rows]
    raw, wanted = [0] * 10_000, [0] * 10_000
    for _, _, f in docs:
        for b in f:
            raw[b] += 1
    for t in target:
        for b in features_of(t)[1]:
            wanted[b] += 1
    s, t = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((y + 1) * (s + 10_000) / ((x + 1) * (t + 10_000)))) for x, y in zip(raw, wanted)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(long[: share * len(long) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def scores_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def resampling_rows():
    rng = random.Random(3)
    rows = [*EDGES, *[(100 + k, " ".join(prose(k, rng.randrange(10, 90), 60))) for k in range(90)]]
    return [(i, t) for i, t in rows if i != 7] + [(7, EDGES[9][1])] + [(500 + k, "Same, words; " * 12) for k in range(40)]


TARGET = ["w1 w2 w3 W4", None, "", " ".join(prose(5, 300, 60))]


def test_resampling(spark, docs_of):
    rows = resampling_rows()
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    docs = docs_of(rows, "rank string, part string")
    got = resampling.resampled(docs.drop("rank"), target, keep=["doc_id"])
    assert scores_of(got) == expected_scores(rows, TARGET)
    clash = resampling.resampled(docs.drop("score"), target)
    assert clash.columns == [*docs.columns, "n_features", "weight", "score", "_rank"]
    assert {r["rank"] for r in clash.collect()} == {0.5} or {r["rank"] for r in clash.collect()} == {"0.5"}
    assert sorted(r["_rank"] for r in clash.collect() if r["_rank"]) == list(range(1, 1 + sum(
        r[4] is not None for r in expected_scores(rows, TARGET))))


def test_resampling_draws_exactly_so_many_of_equal_rows(spark, docs_of):
    docs = docs_of([(None, "one two three four five " * 5)] * 30 + [(1, None)])
    got = resampling.resampled(docs, spark.createDataFrame([], "text string"))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 8))
    assert got.count() == 31


def test_resampling_nothing(nothing, spark):
    assert resampling.resampled(nothing, spark.createDataFrame([("a",)], "text string")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 57, 400, 799, 800])
def test_cutoff_is_the_kth(spark, monkeypatch, k):
    rng = random.Random(k)
    keys = [(rng.choice([3, 3, 3, -2, rng.randrange(9)]), rng.randrange(2), rng.randrange(5), n) for n in range(800)]
    monkeypatch.setattr(resampling, "CHUNK", 100)
    monkeypatch.setattr(resampling, "WORTH_WRITING", 150)
    df = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in resampling.KEY)).repartition(3)
    assert resampling.cutoff(df, k) == sorted(keys)[k - 1]


def best_of(rows, k=5):
    whole = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, n, [math.floor(256 * x) for x in v]))
    out = []
    for i, n, v in whole:
        if i is not None and i % 50 == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, j) for j, m, w in whole if m != n]
            out += [(i, rank, o[4], -o[0]) for rank, o in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def vector_rows(scale=1.0):
    rng = random.Random(11)
    rows = [(k, [scale * rng.randrange(-256, 256) / 256 for _ in range(8)]) for k in range(300)]
    same = [scale * 0.5] * 8
    rows += [(1000 + k, same) for k in range(200)] + [(None, same), (2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8)]
    return rows + [(2150, [float("inf")] + [0.0] * 7), (2200, []), (2201, [1.0])]


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SLICE", 100)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "TILE", 50)
    rows = vector_rows(scale)
    got = topk.top_k(vectors_of(spark, rows, "double"), topk.F.col("vec_id") % 50 == 0)
    assert found(got) == best_of(rows)


def test_top_k_of_few_and_of_repeated_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, -1.0]), (3, [0.5, 0.25])]
    assert found(topk.top_k(vectors_of(spark, few), topk.F.col("vec_id") % 50 == 0)) == best_of(few)
    again = [(50, [1.0, 0.0])] * 3 + [(k, [0.5, 0.5]) for k in range(1, 5)]
    got = found(topk.top_k(vectors_of(spark, again), topk.F.col("vec_id") % 50 == 0, k=3))
    assert got == best_of(again, 3) and len(got) == 9
    assert topk.top_k(vectors_of(spark, few).where("false"), topk.F.col("vec_id") % 50 == 0).count() == 0
    clash = vectors_of(spark, few).withColumn("row", topk.F.lit("x")).withColumn("score", topk.F.lit(1))
    assert found(topk.top_k(clash, topk.F.col("vec_id") % 50 == 0)) == best_of(few)
