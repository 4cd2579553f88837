"""Candidates of fuzzy line dedup: repeated signs, dense blocks, the word-wise bound."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from brute import levenshtein
from conftest import prose

from veilscan.llm import lines


def test_a_sign_between_all_words_does_not_make_lines_alike():
    rows = [" | ".join(prose(k, 9, 90000)) + " |" for k in range(60)]
    prints = lines.simhashes(rows)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert apart[np.triu_indices(len(rows), 1)].min() > lines.BITS


def test_word_counts_once_in_a_line():
    assert lines.simhashes(["one two three four five six"]) == lines.simhashes(["one two two three four five six six"])
    h, first = np.array([5, 7, 5, 5, 7], np.uint64), np.array([0, 3, 5])
    keep = lines.first_of_line(h, first)
    assert [keep[:3].sum(), keep[3:].sum()] == [2, 2] and keep[1] and keep[0] != keep[2]


def test_similar_is_the_edit_similarity():
    rng = random.Random(6)
    for k in range(300):
        a = prose(k, rng.randrange(1, 12), 50)
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = prose(1000 + k, rng.randrange(2), 50)
        a, b = " ".join(a), " ".join(b)
        most = 0.2 * max(len(a), len(b)) + 1e-9
        assert lines.similar(a, b, 0.8) == (levenshtein(a, b) <= most), (a, b)


def test_dense_blocks_give_the_same_lines(docs_of, monkeypatch):
    rng, rows = random.Random(9), []
    for group in range(3):
        words = prose(group, 24, 90000)
        for k in range(25):
            other = list(words)
            other[rng.randrange(24)] = f"edit{group}x{k}"
            rows.append((len(rows), " ".join(other)))
    def gone():
        return {r.doc_id for r in lines.cleaned(docs_of(rows)).where("_gone is not null").collect()}

    found = gone()
    monkeypatch.setattr(lines, "DENSE", 1 << 30)
    assert gone() == found == {k for k in range(75) if k % 25}


def test_pairs_together_are_as_similar_as_one_by_one():
    rng, a, b = random.Random(8), [], []
    for k in range(1500):
        x = "".join(rng.choice("abcdeé ”") for _ in range(rng.choice([0, 1, 20, 63, 64, 65, 128, 190, 400])))
        y = list(x)
        for _ in range(rng.randrange(1 + len(x) // 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = rng.choices("abxyz\U0001f600", k=rng.randrange(3))
        a.append(x)
        b.append("".join(y))
    most = np.array([int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)])
    want = [lines.edit_distance(x, y, int(m)) <= m for x, y, m in zip(a, b, most)]
    assert 300 < sum(want) < 1300
    assert lines.near_enough(a, b, most).tolist() == want
    assert lines.similar_pairs(a, b, 0.8).tolist() == want
    assert lines.similar_pairs([], [], 0.8).tolist() == []


def test_blocks_come_whole():
    keys = [1] * 5 + [2] * 9 + [3] * 2 + [4] * 30
    batches = [pa.RecordBatch.from_pydict({"key": keys[k : k + 4], "part": [0] * len(keys[k : k + 4]), "n": list(range(k, k + len(keys[k : k + 4])))})
               for k in range(0, len(keys), 4)]
    got = [t.to_pydict() for t in lines.whole_blocks(iter(batches), rows=6)]
    assert [n for t in got for n in t["n"]] == list(range(len(keys))) and len(got) > 2
    assert sum(len(set(t["key"])) for t in got) == 4
    assert list(lines.whole_blocks(iter([]))) == []


def test_pair_is_compared_in_one_band(docs_of, monkeypatch, tmp_path):
    """Lines of the same words in another order share all bands, and are not similar."""
    rng, words, rows = random.Random(3), [f"{x}{x}word" for x in "abcdefghijklmnopqrstuvwxyz"], []
    for k in range(40):
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    whole, folder = lines.similar_pairs, str(tmp_path)

    def noted(a, b, least):
        import tempfile

        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as out:
            out.write(str(len(a)))
        return whole(a, b, least)

    monkeypatch.setattr(lines, "similar_pairs", noted)
    assert not lines.cleaned(docs_of(rows)).where("_gone is not null").count()
    pairs = 40 * 39 // 2
    assert pairs <= sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 2 * pairs  # once by sketch, once by SimHash


def test_column_gives_a_lower_bound():
    rng = random.Random(5)
    for k in range(40):
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 200))]
        b = list(a)
        for _ in range(rng.randrange(60)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc"))
            del b[rng.randrange(len(b))]
        b += rng.choices("abc", k=rng.randrange(20))
        column = 64 * rng.randrange(1 + len(b) // 64)
        cells = [levenshtein("".join(a[:n]), "".join(b[:column])) for n in range(len(a) + 1)]
        cells += range(cells[-1] + 1, cells[-1] + 1 + -len(a) % 8)  # rows beyond the text
        step = np.diff(cells)
        up, down = (np.packbits(step == d, bitorder="little")[None] for d in (1, -1))
        least = lines.least_in_column(up, down, column, np.array([len(a) - len(b) + column]))[0]
        distance = levenshtein("".join(a), "".join(b))
        assert least <= distance <= least + 8 + distance - min(
            c + abs(len(a) - n - len(b) + column) for n, c in enumerate(cells[: len(a) + 1]))


def test_long_and_far_apart_pairs_are_dropped_rightly():
    rng, a, b = random.Random(11), [], []
    for k in range(260):
        x = "".join(rng.choices("abcd ", k=rng.randrange(150, 900)))
        y = list(x)
        for _ in range(rng.randrange(1 + len(x) // 2)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(3)] = rng.choices("abcd ", k=rng.randrange(3))
        a.append(x)
        b.append("".join(y) if k % 3 else "".join(rng.choices("abcd ", k=len(x))))
    most = np.array([int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)])
    want = [levenshtein(x, y) <= m if len(x) < 300 else lines.edit_distance(x, y, 1 << 20) <= m for x, y, m in zip(a, b, most)]
    assert 40 < sum(want) < 160
    assert lines.near_enough(a, b, most).tolist() == want
    assert [lines.edit_distance(x, y, int(m)) <= m for x, y, m in zip(a, b, most)] == want
    assert lines.similar_pairs(a, b, 0.8).tolist() == want


def test_short_words_alone_do_not_make_candidates():
    """Lines of other long words between the same short ones: their bands must not meet, however many lines there are."""
    rng, short = random.Random(12), "the of and to is in it a on or".split()
    rows = [" ".join(w for pair in zip(prose(100 + k, 10, 10**9), rng.sample(short, 10)) for w in pair) for k in range(400)]
    _, keys = lines.minhashes(rows)
    met = sum(n * (n - 1) // 2 for band in keys.T for n in np.unique(band, return_counts=True)[1].tolist())
    assert met < 200  # of 79,800 pairs in each of the bands; 6,000 and more where all words weigh the same


def test_recall_of_letter_edits():
    """A letter in a quarter of the words: most pairs meet in a band with sketches near enough, and none is left out later."""
    rng = random.Random(13)
    for n, least in ((8, 0.8), (20, 0.85), (60, 0.85)):
        a, b = [], []
        while len(a) < 300:
            words = ["".join(rng.choices("etaoinshr", k=rng.choice([1, 2, 3, 3, 4, 5, 6, 8, 10]))) for _ in range(n)]
            other = list(words)
            for k in rng.sample(range(n), n // 4):
                at = rng.randrange(len(other[k]))
                other[k] = other[k][:at] + "z" + other[k][at + 1 :]
            if len(" ".join(words)) >= lines.MIN_CHARS:
                a.append(" ".join(words))
                b.append(" ".join(other))
        assert lines.similar_pairs(a, b, 0.8).all()
        (s, k), (t, m) = lines.minhashes(a), lines.minhashes(b)
        near = (k == m).any(axis=1) & (np.bitwise_count(s ^ t) <= lines.SKETCH_BITS)
        assert near.mean() >= least
        far = np.bitwise_count(lines.wide_sketches(a) ^ lines.wide_sketches(b)).sum(axis=1) > lines.WIDE_BITS
        assert not (near & far).any()


def test_words_are_hashed_alike_with_and_without_numbers():
    rows = ["one two three four five six", "tel 030 1234 or 17 of page 9 of the book", "这是一个没有空格的很长的句子它在两份文件里都出现过一次",
            "Überall für die Straße und zurück in größe", "12 34 56 78 90 12 34 56 78"]
    prints, sketches, keys = lines.fingerprints(rows)
    assert prints.tolist() == lines.simhashes(rows).tolist()
    assert [x.tolist() for x in (sketches, keys)] == [x.tolist() for x in lines.minhashes(rows)]


def test_hot_keys_in_slices_give_the_same_lines(docs_of, monkeypatch):
    """Blocks and bands dealt over slices: all pairs of a slice and of two slices still meet, each once."""
    rng, rows = random.Random(9), []
    for group in range(3):
        words = prose(group, 24, 90000)
        for k in range(30):
            other = list(words)
            other[rng.randrange(24)] = f"edit{group}x{k}"
            rows.append((len(rows), " ".join(other)))

    def gone():
        return {r.doc_id for r in lines.cleaned(docs_of(rows)).where("_gone is not null").collect()}

    monkeypatch.setattr(lines, "SLICE", 4)
    monkeypatch.setattr(lines, "SMALL_BLOCK", 6)
    assert gone() == {k for k in range(90) if k % 30}


def test_a_pair_of_slices_is_compared_where_the_slices_meet():
    none, mixed, side = -1, lines.MIXED, lines.SIDE
    a = np.array([[8, 16, none], [8 | mixed, 24, none], [8 | mixed, 24, none], [8 | lines.BLOCK, 16, 24]])
    b = np.array([[16, none, none], [8 | mixed | side, 24, none], [8 | mixed, 24, none], [8 | lines.BLOCK, 24, none]])
    for key, want in ((8, [0, 0, 0, 0]), (16, [1, 0, 0, 0]), (8 | mixed, [0, 1, 0, 0]), (24, [0, 0, 1, 1]), (8 | lines.BLOCK, [0, 0, 0, 1])):
        assert lines.shared_first(a, b, np.full(4, key)).tolist() == [bool(w) for w in want]


def test_spanning_pairs_are_those_that_join():
    a, b = np.array([1, 2, 1, 4, 4, 7]), np.array([2, 3, 3, 5, 1, 7])
    assert lines.spanning(a, b).tolist() == [True, True, False, True, True, False]
