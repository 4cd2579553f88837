"""Language identification, quality selection and mixing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest import EDGES

from veilscan.llm import langid, mixing, quality

SYLLABLES = {"aa": "ka lo mi tun", "bb": "schrei ung zach pfe", "cc": "eau ille oux trè"}


def text_in(lang: str, seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture
def spoken(docs_of):
    rows = [(k, text_in("aa bb cc".split()[k % 3], k), "aa bb cc".split()[k % 3], f"src{k % 5}") for k in range(150)]
    return docs_of(rows + [(i, t) for i, t in EDGES])


def test_held_out_languages(spoken):
    model = langid.fit(spoken)
    assert model.languages == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    rows = langid.identify(spoken, model).withColumn("out", langid.held_out(langid.F.col("doc_id"))).collect()
    assert len(rows) == 150 + len(EDGES)
    for r in rows:
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        if r.lang:
            assert r.lang_pred == r.lang


def test_rejected_documents_go(spoken):
    kept = langid.accepted(spoken)
    assert kept.columns == spoken.columns
    assert kept.where("lang is not null").count() == 150
    assert kept.where("text is null or text = ''").count() == 0


def test_language_edges(edges, nothing, docs_of):
    assert {r.lang_pred for r in langid.identify(edges, langid.fit(edges)).collect()} == {"und"}
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    one = docs_of([(k, "some words", "xx") for k in range(9)] + [(20, "1 2 3", None)])
    assert sorted({r.lang_pred for r in langid.identify(one, langid.fit(one)).collect()}) == ["und", "xx"]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert set(np.unique(code)) == {-1, 1} and apart.min() >= (1 if n == 2 else 2)
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_many_languages(docs_of):
    langs = [f"l{k}" for k in range(7)]
    rng, rows = random.Random(3), []
    own = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for x in langs}
    for k in range(140):
        rows.append((k, " ".join(rng.choice(own[langs[k % 7]]) for _ in range(80)), langs[k % 7]))
    docs = docs_of(rows)
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert sum(r.lang_pred == r.lang for r in found) > 135


# quality


def test_junk_is_not_selected(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(200):
        junk = k % 4 == 0
        words = [text_in("aa", 1000 + k, 1) + ("$$$" if junk else "") for _ in range(50)]
        rows.append((k, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((k, int(not junk), 0))
    labels = spark.createDataFrame([*labels, (None, 1, 0), (999, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.selected for r in quality.selected(docs_of(rows), labels, k=150).collect()}
    assert sum(got.values()) == 150
    assert all(got[k] == (k % 4 != 0) for k in range(200))


def test_top_k_by_ranges(spark):
    rng = random.Random(6)
    values = [rng.randrange(1 << 62) for _ in range(300)] + [5, 5, 5]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 150, 300, 303):
        assert quality.smallest_taken(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.smallest_taken(keys, 304) is None


def test_quality_edges(edges, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.selected(edges, none, k=3).collect()
    assert len(got) == len(EDGES) and all(r.log_weight == 0 for r in got)
    assert sum(r.selected for r in got) >= 3
    assert quality.selected(nothing, none).count() == 0


# mixing


def fill(budget, supplies, weights):
    """Water filling one sibling at a time."""
    given, left = [0.0] * len(supplies), set(k for k, w in enumerate(weights) if w > 0)
    while left:
        level = (budget - sum(given[k] for k in range(len(supplies)) if k not in left)) / sum(weights[k] for k in left)
        short = {k for k in left if supplies[k] <= level * weights[k]}
        if not short:
            for k in left:
                given[k] = level * weights[k]
            break
        for k in short:
            given[k] = supplies[k]
        left -= short
    return given


@pytest.mark.parametrize("seed", range(6))
def test_filling(spark, seed):
    rng = random.Random(seed)
    supplies, weights = [rng.randrange(200) for _ in range(7)], [rng.randrange(5) for _ in range(7)]
    budget = rng.randrange(700)
    df = spark.createDataFrame([(0, f"n{k}", s, w, budget) for k, (s, w) in enumerate(zip(supplies, weights))],
                               "all int, node string, supply long, weight int, budget long")
    got = {r.node: r.quota for r in mixing.filled(df, ["all"], "node", "budget", "quota").collect()}
    for k, x in enumerate(fill(budget, supplies, weights)):
        assert abs(got[f"n{k}"] - int(x + 1e-6)) <= 1


def test_mixture_follows_budgets(docs_of):
    rows = [(k, "w " * (5 + k % 7), "en" if k % 3 else "de", f"src{k % 9}") for k in range(400)]
    docs = docs_of(rows)
    total = sum(len(r[1].split()) for r in rows)
    one = mixing.mixed(docs, share=0.5).collect()
    assert len(one) == 400
    taken = sum(r.n_tokens * r.n_copies for r in one)
    assert 0.5 * total - 12 * 20 <= taken <= 0.5 * total
    out = mixing.mixture(docs, share=0.5)
    assert out.columns == [*docs.columns, "epoch"]
    assert out.count() == sum(r.n_copies for r in one)
    everything = mixing.mixed(docs, share=5.0, epochs=2).collect()
    assert {r.n_copies for r in everything} == {2}


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("d0", "en", "a", 10), ("d0", "en", "b", 500), ("d0", "de", "c", 500), ("d1", "en", "d", 900)],
        "domain string, lang_leaf string, source_leaf string, tokens long")
    one = mixing.F.lit(1)
    found = mixing.budgets(leaves, 400, 1, {"domain": one, "lang": one, "source": one}).collect()
    # d0 and d1 share 400; in d0 each language has 100; source a has 10 only, so b takes the other 90.
    assert {r.source_leaf: r.quota for r in found} == {"a": 10, "b": 90, "c": 100, "d": 200}


def test_mixing_edges(edges, nothing):
    got = mixing.mixed(edges).collect()
    assert len(got) == len(EDGES)
    assert {r.n_copies for r in got if r.n_tokens == 0 and r.text is None} <= {0, 1, 2}
    assert mixing.mixture(nothing).count() == 0
