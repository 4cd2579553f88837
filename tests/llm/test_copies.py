"""Exact and near duplicates, repeated passages and lines, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from brute import levenshtein, removed_lines, repeats, simhash_groups
from conftest import EDGES, prose

from veilscan.llm import exact, lines, links, simhash, substrings


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# exact


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_edges(edges):
    got = rows_of(exact.deduplicate(edges), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == expected_exact(EDGES)


def test_exact_nothing(nothing):
    assert exact.deduplicate(nothing).count() == 0


def test_chunks_concatenate_and_resynchronise(spark):
    body = " ".join(prose(3, 8000, 3000))
    df = spark.createDataFrame([(body,), ("inserted words, " + body,), ("x" * 50000,), ("",)], "t string")
    rows = df.select("t", exact.chunks(df.t).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.8 * len(rows[0].c) > 8


def test_recipes_tell_colliding_chunks_apart(spark, monkeypatch, docs_of):
    # All chunks share one 64-bit hash: only the verified numbers differ.
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: exact.F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b" * 9000), (5, "a" * 9000)]
    got = rows_of(exact.deduplicate(docs_of(rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == expected_exact(rows)


# near


def near_rows():
    rng, rows = random.Random(5), list(EDGES)
    base = prose(9, 300)
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((100 + k, " ".join(words)))
    return rows + [(200 + k, " ".join(prose(50 + k, 40))) for k in range(30)]


def test_simhash_groups(docs_of):
    rows = near_rows()
    got = simhash.grouped(docs_of(rows))
    got = got.select("doc_id", simhash.F.lower(simhash.F.lpad(simhash.F.hex("print"), 16, "0")).alias("f"), "component_id")
    assert rows_of(got, "doc_id", "f", "component_id") == sorted(simhash_groups(rows), key=repr)


def test_simhash_small_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 4)
    rows = near_rows()
    got = {(r.doc_id, r.component_id) for r in simhash.grouped(docs_of(rows)).collect()}
    assert got == {(i, c) for i, _, c in simhash_groups(rows)}


def test_simhash_keeps_one_row_of_each_group(docs_of):
    rows = near_rows()
    kept = simhash.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    groups = {c for _, _, c in simhash_groups(rows)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(groups, key=repr)


def test_simhash_nothing(nothing):
    assert simhash.grouped(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_close_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) for c in centres]
                                      + [rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    values = values[np.argsort(links.gray_rank(values))]
    a, b = values[::2], values[1::2]
    for left, right in ((values, None), (a, b), (a[:3], b), (a, b[:1])):
        found = set()
        links.close(left, right, 3, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
        other = left if right is None else right
        expected = {(i, j) for i in range(len(left)) for j in range(i + 1 if right is None else 0, len(other))
                    if int(left[i] ^ other[j]).bit_count() <= 3}
        assert found == expected


def test_gray_rank_inverts_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (links.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_paths_stars_and_rings(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 700)]
    ring = [(900 + k, 900 + (k + 1) % 7) for k in range(7)] + [(3, 3)]
    got = dict(links.components(spark.createDataFrame(path + star + ring, "a long, b long")).collect())
    assert got == ({k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 700)} | {k: 900 for k in range(900, 907)})
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# passages


def passage_rows():
    shared, rows = prose(20, 70, 5000), list(EDGES)
    for k in range(20):
        rows.append((300 + k, " ".join(prose(400 + k, 40, 9000) + shared[: 49 + k] + prose(600 + k, 30, 9000))))
    rows.append((290, " ".join(prose(77, 15, 9000) + shared[10:62] + shared)))
    rows.append((340, " ".join(["again and"] * 400)))
    rows.append((341, " ".join(["again and"] * 90)))
    whole = prose(31, 400, 9000)
    rows += [(350, "\n".join(whole)), (351, "  ".join(whole[:200] + ["edit"] + whole[200:])), (349, " ".join(whole[100:260]))]
    return rows


def test_repeated_passages(docs_of):
    rows = passage_rows()
    got = substrings.repeats(docs_of(rows))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(repeats(rows), key=repr)


def test_repeated_passages_in_small_shards(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    monkeypatch.setattr(substrings, "SLICE_WORDS", 200)
    rows = passage_rows()
    got = substrings.repeats(docs_of(rows))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(repeats(rows), key=repr)


def test_repeated_passages_nothing(nothing):
    assert substrings.repeats(nothing).count() == 0


# lines


def line_rows():
    rng, rows = random.Random(8), [r for k, r in enumerate(EDGES) if r[0] not in (5, 7) or EDGES[k - 1][0] != r[0]]
    rows = [r for r in rows if r[0] is not None] + [(None, "A line of six words here.\nshort")]
    long = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in prose(61, 90, 3000)]
    for k in range(25):
        words = list(long)
        words[rng.randrange(90)] = "edit"
        rows.append((400 + k, f"Chapter {k}\n" + " ".join(words) + "\n\nA line of six words HERE!\nshort\n" + f"Page {k} of the book of lines"))
    return rows


def test_lines(docs_of):
    rows = line_rows()
    gone = removed_lines(rows, lines.normalised, lines.takes_part, lines.simhashes)
    got = {r.doc_id: (r.text, set(r._gone or [])) for r in lines.cleaned(docs_of(rows)).collect()}
    assert {i: g for (i, _), g in zip(rows, gone)} == {i: g for i, (_, g) in got.items()}
    for (i, text), g in zip(rows, gone):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in g)
        assert got[i][0] == kept
    assert sum(map(len, gone)) > 40


def test_lines_in_slices(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "SLICE", 5)
    rows = line_rows()
    gone = removed_lines(rows, lines.normalised, lines.takes_part, lines.simhashes)
    got = {r.doc_id: set(r._gone or []) for r in lines.cleaned(docs_of(rows)).collect()}
    assert got == {i: g for (i, _), g in zip(rows, gone)}


def test_lines_edges(edges, nothing):
    got = lines.deduplicated(edges)
    assert got.columns == edges.columns and got.count() == len(EDGES)
    assert lines.deduplicated(nothing).count() == 0


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abç") for _ in range(rng.randrange(25))) for _ in range(2))
        most, d = rng.randrange(25), levenshtein(a, b)
        got = lines.edit_distance(a, b, most)
        assert got == d if d <= most else got > most


def test_a_passage_of_all_documents_in_many_surroundings(docs_of):
    """Texts share one passage; few different words before and after it make many first owners of windows."""
    rng, common = random.Random(12), prose(33, 60)
    rows = [(n, " ".join([*prose(500 + n, 20), *rng.choices(["x", "y", "z"], k=3), *common, *rng.choices(["x", "y"], k=3), *prose(900 + n, 20)]))
            for n in range(120)]
    assert rows_of(substrings.repeats(docs_of(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(repeats(rows), key=repr)


def test_a_hit_costs_the_windows_around_it_and_not_the_owners_of_its_block():
    shard, common = substrings.Shard(), prose(3, 60)
    for n in range(400):
        shard.add(n, " ".join([f"own{n}", *common[:49]]))
    shard.add(0, " ".join(common))
    shard.compile()
    assert max(len(spots) for spots in shard.windows.values()) == 1
    assert shard.repeats(7, " ".join(["own3", *common])) == [(0, 61)]
    assert shard.repeats(7, " ".join(["own9", *common])) == [(1, 61)]
    assert shard.repeats(0, " ".join(common)) == []
