"""Lines of rows without own ids, with digits, short, and edited: whole results."""

from __future__ import annotations

import random
from collections import Counter

from conftest import prose

from veilscan.llm import lines


def texts(df):
    return Counter(r.text for r in df.collect())


def test_only_lines_found_equal_are_cut(docs_of):
    one, two = "unique text A of the first row\nboiler line of five words", "boiler line of five words\nunique text B of another row"
    for ids in ((None, None), (4, 4)):
        got = "\n".join(texts(lines.deduplicated(docs_of(list(zip(ids, (one, two)))))).elements()).split("\n")
        assert Counter(got) == Counter({"unique text A of the first row": 1, "unique text B of another row": 1,
                                        "boiler line of five words": 1})


def test_rows_with_equal_id_and_text_keep_one(docs_of):
    rows = [(5, "one line of five words\n\nand another line of words")] * 3 + [(None, "a row without id of words")] * 2
    got = texts(lines.deduplicated(docs_of(rows)))
    assert got == {rows[0][1]: 1, rows[3][1]: 1, "": 3}


def test_other_numbers_are_other_lines(docs_of):
    kept = ["12 34 56 78 90", "98 71 65 43 21", "on 11 12 1987 it cost 4305 and 17 more", "on 25 06 2013 it cost 9981 and 62 more"]
    rows = [(k, x) for k, x in enumerate(kept)] + [(9, "Page 7 of a very long book of lines"), (10, "Page 12 of a very long book of lines")]
    assert texts(lines.deduplicated(docs_of(rows))) == Counter([*kept, rows[4][1], ""])


def test_short_lines_go_where_equal(docs_of):
    long = "这是一个没有空格的很长的句子它在两份文件里都出现过一次"
    rows = [(1, f"Menu\n\nC++\n-----\n{long}"), (2, f"C#\n  Menu\n\n=====\nChapter 1\n{long}"), (3, "Chapter 2\n-----\n \nC++\nmenu")]
    got = {r.doc_id: r.text for r in lines.deduplicated(docs_of(rows)).collect()}
    assert got == {1: rows[0][1], 2: "C#\n\n=====\nChapter 1", 3: "Chapter 2\n \nmenu"}


def test_one_word_edits_are_found(docs_of):
    """Recall against edit similarity alone, of lines in which one word is another."""
    rng, rows = random.Random(4), []
    for n in (8, 12, 20, 40, 60):
        for k in range(40):
            words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in prose(1000 * n + k, n, 90000)]
            other = list(words)
            other[rng.randrange(n)] = "edited"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    pairs = list(zip(rows[::2], rows[1::2]))
    assert all(lines.similar(a[1], b[1], 0.8) for a, b in pairs)
    gone = {r.doc_id for r in lines.cleaned(docs_of(rows)).where("_gone is not null").collect()}
    assert gone <= {b[0] for _, b in pairs}
    assert len(gone) >= 0.97 * len(pairs)
