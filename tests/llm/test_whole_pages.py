"""Pages whose main text must not be lost whole."""

from __future__ import annotations

from test_texts import extracted, page


def test_articles_in_excluded_parts_do_not_count(spark):
    comments = '<div class="comments"><article><p>Reader {0} says no.</p></article></div><aside><article>Teaser {0}</article></aside><main></main>'
    rows = [(k, "http://h.example/", page(k, f'<div class="c1"><p>Story number {k} goes on.</p></div>' + comments.format(k))) for k in range(5)]
    for k, (text, _) in extracted(spark, rows).items():
        assert text == f"Story number {k} goes on."


def test_copies_of_one_page_keep_their_text(spark):
    story = '<div class="c1"><p>The one story of this host.</p></div>'
    rows = [(k, "http://h.example/", page(k, story)) for k in range(6)]
    assert {text for text, _ in extracted(spark, rows).values()} == {"The one story of this host."}
    others = [(10 + k, "http://h.example/", page(k, f'<section class="c2"><p>Another story, {k}.</p></section>')) for k in range(2)]
    for k, (text, _) in extracted(spark, rows + others).items():
        assert text == ("The one story of this host." if k < 10 else f"Another story, {k - 10}.")
