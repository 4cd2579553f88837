"""Personal data, benchmark passages and web pages."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import base_spans, smith_waterman
from conftest import EDGES, prose

from veilscan.llm import decontam, pii, templates, words

TEXTS = [
    "mail a.b@c.de, x@@y.zz.w q@r.s_t@u.v.w. and é.34@mail7.example.com", "a@b", "a@b.c@d.e", "@@@ a@b..c",
    "ip 1.2.3.4.5 and 256.1.1.1 001.002.003.004 9.9.9 1.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 1",
    "5" * 300, "79927398713 4012888888881881x378282246310005", "+1 (017) 555-7713 +49 30 1234567- +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+1+2 345 678 901", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" version 1.2.3.4',
    "😀 a@b.co 😀 10.0.0.1", "", None, "x" * 3000 + "@" + "y" * 3000, "1 " * 9000, "1." * 1500,
]


def test_base_spans_equal_the_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.detected(docs).collect():
        expected = base_spans(TEXTS[r.doc_id])
        got = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert got == expected, TEXTS[r.doc_id][:60]


def test_long_runs_take_linear_time(spark):
    texts = ["x" * 400_000 + "@", "7" * 400_000, "+1" + " " * 400_000, "1." * 200_000 + "@", "Aa1_" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.detected(docs).count() == len(texts)


def test_random_base_spans(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("01 2.-+(@a%_\n)é") for _ in range(rng.randrange(120))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detected(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_spans(texts[r.doc_id])


def test_added_spans(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(k, f'the token = "{secret}" and mail {k}@b.de or card 4111111111111111') for k in range(30)]
    for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, ends = rows[r.doc_id][1], [(s.start, s.end) for s in r.spans]
        assert secret in [text[s.start : s.end] for s in r.spans if s.kind == "secret"]
        assert all(b <= c for (_, b), (c, _) in zip(sorted(ends), sorted(ends)[1:]))


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.9, 0.85, 0.5])
    votes = np.where(rng.random((4000, 3)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    p, tables = pii.reliabilities(votes, np.zeros(4000, int), np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.88
    assert abs(tables[2, 1, 2] - 0.5) < 0.1 < tables[0, 1, 2] - tables[0, 0, 2]


def test_pii_edges(edges, nothing):
    assert pii.detected(edges).count() == len(EDGES)
    assert pii.detected(nothing).count() == 0


# benchmark


def test_alignment_scores():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        score, end = decontam.aligned(a, b)
        best = smith_waterman(a.tolist(), b.tolist())
        assert score == best / (2 * len(a))
        assert smith_waterman(a.tolist(), b[:end].tolist()) == best


def leaked(spark):
    rng, items, rows = random.Random(3), [], []
    for k in range(12):
        items.append((k, " ".join(prose(700 + k, 30, 4000))))
    for k in range(60):
        body = prose(800 + k, 200, 4000)
        if k < 36:
            item = items[k % 12][1].split()
            for _ in range(k // 12 * 3):
                item[rng.randrange(30)] = "edit"
            body[90:90] = [w.upper() + "," for w in item]
        rows.append((k, " ".join(body)))
    return items, rows


def test_leaks_are_found(spark, docs_of):
    items, rows = leaked(spark)
    benchmark = spark.createDataFrame([*items, (None, "a b c d"), (77, None), (78, "")], "item_id long, text string")
    docs = docs_of(rows + EDGES)
    got = {r.doc_id: r for r in decontam.matched(docs, benchmark).collect() if r.doc_id is not None and r.doc_id not in range(1, 11)}
    for k, text in rows:
        if k in range(1, 11):
            continue
        assert got[k]["items"] == ([k % 12] if k < 36 else [])
        if k < 36:
            own = [w.strip(",").lower() for w in text.split()]
            full = smith_waterman(items[k % 12][1].split(), own)
            assert got[k].best_score == full / 60 and got[k].best_item == k % 12
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns


def test_blocks_of_the_benchmark_agree(spark, docs_of, monkeypatch):
    items, rows = leaked(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "best_score", "best_item", "items"]
    whole = sorted(map(repr, decontam.matched(docs_of(rows), benchmark).select(columns).collect()))
    monkeypatch.setattr(decontam.blocks, "__defaults__", (500,))
    parts = sorted(map(repr, decontam.matched(docs_of(rows), benchmark).select(columns).collect()))
    assert parts == whole


def test_benchmark_edges(edges, nothing, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one"), (2, "lone text of a row")], "item_id long, text string")
    assert decontam.clean(edges, none).count() == len(EDGES)
    assert decontam.clean(nothing, some).count() == 0
    assert decontam.matched(edges, some).count() == len(EDGES)


def test_words_of_buffers():
    import re

    import pyarrow as pa

    texts = ["a  bb\tc", "", None, "x", " lead and trail ", "é ü z", "tail"]
    for size in (1, 5, 1000):
        got = []
        for first, end, data, offsets in words.pieces(pa.array(texts), size):
            w = words.Words(data, offsets)
            for k in range(end - first):
                got.append([w.word(i).decode() for i in range(w.first[k], w.first[k + 1])])
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


# pages


def page(k: int, body: str, extra: str = "") -> str:
    return (f'<!DOCTYPE html><html><head><title>t{k}</title><script>var t="</p>";</script></head><body><nav><ul>'
            f'<li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="notice">We use cookies.</div>{extra}'
            f'{body}<footer>&copy; host</footer></body></html>')


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: (r.text, r.n_chars) for r in templates.extracted(df).collect()}


def test_article_text(spark):
    rows = [(k, f"https://h.example/{k}", page(k, f"<article><h1>Head &amp; {k}</h1><p><b>Bold\n text {k}.<br><p>Two&nbsp;{k}</p>"
             f"<aside>side</aside><div class='comments'><p>reader</p></div></article>")) for k in range(8)]
    for k, (text, n) in extracted(spark, rows).items():
        assert text == f"Head & {k}\nBold text {k}.\nTwo {k}" and n == len(text)


def test_slots_of_a_template_without_article(spark):
    rows = [(k, "https://user@h.example:80/x", page(k, f'<div class="c1"><p>Story number {k} goes on.</p><p>More of {k}.</p></div>',
             '<div class="x7"><p>Same words on every page.</p></div><div class="x8"><a href="/q">Link a</a> <a href="/r">Link b</a></div>'))
            for k in range(6)]
    for k, (text, _) in extracted(spark, rows).items():
        assert text == f"Story number {k} goes on.\nMore of {k}."


@pytest.mark.parametrize("around", ['<div class="content legal-affairs"><article>{}</article></div>',
                                    '<article><section class="social-policy">{}</section></article>',
                                    '<div id="search"><main>{}</main></div>', '<form id="aspnetForm"><article>{}</article></form>'])
def test_names_around_a_story_do_not_take_it(around):
    html = around.format("<p>The story.</p>") + '<div class="comments"><article><p>A reader.</p></article></div>'
    assert templates.main_text(html, templates.Template(None)) == "The story."


def test_records_beside_the_story_go_where_the_template_shows_them(spark):
    """No list has their names: they repeat, in another gap than the one with most text."""
    rows = []
    for k in range(6):
        told = "".join(f"<p>Part {n} of story {k} tells a good deal more than readers do.</p>" for n in range(3 + k))
        said = "".join(f'<div class="u1"><h4>Reader {k} {n}</h4><p>I think {n} of {k}.</p></div>' for n in range(1 + k % 3))
        rows.append((k, "http://h/", f'<html><body><h1>Site</h1><div class="s">{told}</div><div class="reader-feedback">{said}</div></body></html>'))
    for k, (text, _) in extracted(spark, rows).items():
        assert text == "\n".join(f"Part {n} of story {k} tells a good deal more than readers do." for n in range(3 + k))


def test_classes_are_tokens_of_equal_vectors(spark):
    rows = [(k, "http://h/", f"<body><h1>Head</h1><div>{f'<ul><li>x{k}</li></ul>' * (k % 3)}<p>t{k}</p></div></body>")
            for k in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    events = templates.events_of(df)
    got = {frozenset(r.tokens) for r in templates.classes(templates.vectors(events)).collect()}
    held = [Counter(t for t, _ in templates.parsed(html)[1]) for _, _, html in rows]
    starts = {t for _, _, html in rows for t, k in templates.parsed(html)[1] if k != templates.END}
    vectors = defaultdict(set)
    for token in set().union(*held):
        vectors[tuple(c[token] for c in held)].add(token)
    want = {frozenset(v) for k, v in vectors.items() if len(v & starts) >= templates.LEAST_TOKENS and sum(map(bool, k)) >= 3}
    assert got == want and len(want) > 1


def test_order_and_nesting_decide_on_a_class():
    found = [{"class": 1, "repeats": False, "tokens": [10, 11, 12]}, {"class": 2, "repeats": True, "tokens": [20, 21]}]
    shape = templates.Template(found)
    assert shape.unordered([10, 20, 21, 20, 21, 11, 12]) == set()
    assert shape.unordered([10, 12, 11]) == {1} and shape.unordered([10, 11, 12, 20]) == {2}
    slots, gaps, torn = shape.walk([10, 20, 5, 21, 6, 11, 7, 12, 8])
    assert [s for s in slots if s] == [((2, 0), (1, 0)), ((1, 0), (1, 0)), ((1, 1), (1, 1)), ((0, 0), (0, 0))]
    assert gaps == {(1, (0, 0)), (2, (1, 0))} and not torn
    assert shape.walk([10, 20, 11, 21, 12])[2] == {2}


def test_page_edges(spark):
    rows = [(None, None, None), (1, None, ""), (2, "x", "plain words"), (3, "http://h/", "<p>a<p>b<li>c"),
            (4, "http://h/", "<article><p>cut <b>off"), (5, "http://h/", "<p title=it's>x</p> 1 < 2 <!-- open"), (5, "http://h/", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in templates.extracted(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, ""), (1, ""), (2, "plain words"), (3, "a\nb\nc"), (4, "cut off"),
                                            (5, "x\n1 < 2"), (5, "x")], key=repr)
    assert templates.extracted(df.where("false")).count() == 0
