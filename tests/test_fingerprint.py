import random

from pyspark.sql import functions as F

import model
from veilscan.functions import text as tx
from veilscan.operators import fingerprint as fp
from veilscan.operators import set_overlap as so

PROSE = (
    "our northern depot moved nine hundred pallets last quarter while the southern depot stayed closed for repairs "
    "and the board agreed to sell the older trucks before winter so that insurance costs fall by a fifth next year"
)


def sets(spark, *texts, k=5, window=4):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    rows = df.select("n", tx.fingerprint(F.col("text"), k, window).alias("f")).orderBy("n").collect()
    return [set(r.f) for r in rows]


def ratio(a, b):
    return max(len(a & b) / len(a), len(a & b) / len(b)) if a and b else 0.0


def test_sets_equal_the_plain_model(spark):
    rng = random.Random(3)
    texts = ["", "...", "one", "Ünder_score été, 42!"] + [" ".join(rng.choice("abcde") for _ in range(n)) for n in range(1, 40)]
    assert sets(spark, *texts) == [model.fingerprint(t) for t in texts]
    for k, w in ((3, 3), (2, 5), (1, 1), (4, 8)):
        assert sets(spark, *texts, k=k, window=w) == [model.fingerprint(t, k, w) for t in texts]


def test_containment_bounds(spark):
    words = PROSE.split()
    base, edited, excerpt, swapped, other = sets(
        spark, PROSE, PROSE + " with a covering note", " ".join(words[:20]), " ".join(words[20:] + words[:20]), "menu for monday"
    )
    assert 0 < len(base) < len(words)
    assert ratio(base, edited) > 0.7 and ratio(excerpt, base) > 0.8 and ratio(swapped, base) > 0.6 and ratio(base, other) < 0.1


def corpus_of(spark, *texts):
    df = spark.createDataFrame(
        [(n, f"d{n}", "me", 7, "hold", t) for n, t in enumerate(texts)], "document_id bigint, name string, owner string, severity int, action string, text string"
    )
    return fp.register(df)


def test_all_pairs_are_found_with_hot_copies_and_hot_text(spark):
    """A third of the documents are one text and every registered text shares a common part."""
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(60)]
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    own = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) for _ in range(30)]
    registered, fingerprints = corpus_of(spark, *[f"{common} {t}" for t in own[:20]], *own[20:], "", own[3])
    texts = [own[0]] * 20 + [f"{t} {common}" for t in own[:15]] + own[15:] + ["", "x y"] + [common] * 3
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "job_id bigint, text string")

    def pairs(**options):
        return {(r.job_id, r.document_id, r.overlap, round(r.ratio, 12)) for r in fp.corpus_matches(docs, registered, fingerprints, **options).collect()}

    expected = set()
    for d in registered.collect():
        assert d.shingle_count > 0
    reference = [f"{common} {t}" for t in own[:20]] + own[20:] + ["", own[3]]
    reference = [model.fingerprint(t) for t in reference]
    for n, t in enumerate(texts):
        q = model.fingerprint(t)
        for m, d in enumerate(reference):
            if ratio(q, d) >= 0.35:
                expected.add((n, m, len(q & d), round(min(1.0, ratio(q, d)), 12)))
    assert len(expected) > 200
    assert pairs() == expected
    for hot_pairs in (0, 1, 50):
        assert pairs(hot_pairs=hot_pairs) == expected


def test_disabled_and_removed_documents_do_not_match(spark):
    registered, fingerprints = corpus_of(spark, PROSE, PROSE + " and more words at the end of it")
    docs = spark.createDataFrame([(1, PROSE)], "job_id bigint, text string")
    assert fp.corpus_matches(docs, registered, fingerprints).count() == 2
    assert fp.corpus_matches(docs, registered.withColumn("enabled", F.col("document_id") == 1), fingerprints).count() == 1
    after = fp.unregister(registered, fingerprints, registered.filter("document_id = 0").select("document_id"))
    assert [r.document_id for r in fp.corpus_matches(docs, *after).collect()] == [1]
    assert fp.exact_copies(docs, registered).first().document_id == 0


def test_pages_join_in_order_and_shingles_cross_breaks(spark):
    words = PROSE.split()
    pages = spark.createDataFrame(
        [(1, 2, " ".join(words[7:12])), (1, 1, " ".join(words[:7])), (1, 3, " ".join(words[12:])), (2, 1, "alone")], "job_id bigint, page int, text string"
    )
    texts = {r.job_id: r.text for r in fp.document_text(pages).collect()}
    assert texts[1].split() == words and texts[2] == "alone"
    assert sets(spark, texts[1]) == sets(spark, PROSE)


def test_hash_choice_does_not_change_containment_of_copies(spark):
    docs = spark.createDataFrame([(1, PROSE)], "job_id bigint, text string")
    df = spark.createDataFrame([(5, "d", "o", 7, "hold", PROSE)], "document_id bigint, name string, owner string, severity int, action string, text string")
    registered, fingerprints = fp.register(df, hashing="xxhash64")
    assert fp.corpus_matches(docs, registered, fingerprints, hashing="xxhash64").first().ratio == 1.0


def test_page_by_page_prints_equal_those_of_the_joined_text(spark, monkeypatch):
    """Short, blank and long pages in any order, and groups of only four pages."""
    monkeypatch.setattr(fp, "PAGE_GROUP", 4)
    rng = random.Random(11)
    jobs = {}
    for job in range(60):
        pages = [" ".join(rng.choice("abcdefg") + rng.choice("hij") for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9, 30]))) for _ in range(rng.randint(1, 40))]
        jobs[job] = [p if p or rng.random() < 0.5 else " .. " for p in pages]
    jobs[60] = ["one", "", "two three"]
    jobs[61] = ["."]
    rows = [(j, n, t) for j, pages in jobs.items() for n, t in enumerate(pages, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id bigint, page int, text string")
    got = {}
    for r in fp.paged_prints(df).collect():
        assert r.h not in got.setdefault(r.job_id, set())
        got[r.job_id].add(r.h)
    assert got == {j: f for j, pages in jobs.items() if (f := model.fingerprint("\n".join(pages)))}
    assert fp.paged_prints(df, 2, 3).count() == sum(len(model.fingerprint("\n".join(p), 2, 3)) for p in jobs.values())


def test_corpus_matches_of_pages_equal_those_of_texts(spark):
    words = PROSE.split()
    registered, fingerprints = corpus_of(spark, PROSE, "unrelated words only in this one here and there")
    pages = spark.createDataFrame([(1, n + 1, w) for n, w in enumerate(words)] + [(2, 1, "nothing in common")], "job_id bigint, page int, text string")
    for hot in (0, 10_000):
        got = fp.corpus_matches(pages, registered, fingerprints, hot_pairs=hot).collect()
        assert [(r.job_id, r.document_id, r.ratio) for r in got] == [(1, 0, 1.0)]


def test_overlaps_hold_pairs_below_the_threshold(spark):
    """All pairs that share anything, whatever the sizes: 30 texts against 30 with 12 common words."""
    common = " ".join(PROSE.split()[:12])
    tail = "z{0}a z{0}b z{0}c z{0}d z{0}e z{0}f z{0}g z{0}h z{0}i z{0}j z{0}k z{0}l z{0}m z{0}n z{0}o z{0}p z{0}q z{0}r z{0}s z{0}t"
    texts = [f"{common} {' '.join(tail.format(n + 60 * k) for k in range(6))}" for n in range(60)]
    registered, fingerprints = corpus_of(spark, *texts[:30])
    docs = spark.createDataFrame(list(enumerate(texts[30:])), "job_id bigint, text string")
    assert fp.overlaps(docs, fingerprints, registered).count() == 900
    assert fp.corpus_matches(docs, registered, fingerprints, threshold=0.0, hot_pairs=0).count() == 900


def random_sets(rng, n, common):
    """Sets of which many are equal, and many share most of a common part."""
    made = []
    for k in range(n):
        kind = k % 4
        if kind == 0 and made:
            made.append(set(rng.choice(made)))
        elif kind == 1:
            made.append(set(rng.sample(common, rng.randint(len(common) // 2, len(common)))) | set(rng.sample(range(900), rng.randint(0, 9))))
        elif kind == 2:
            made.append(set(common))
        else:
            made.append(set(rng.sample(range(300), rng.randint(1, 100))))
    return made


def test_overlaps_of_random_sets_at_many_thresholds(spark):
    rng = random.Random(21)
    common = list(range(5000, 5040))
    left, right = random_sets(rng, 60, common), random_sets(rng, 60, common)
    right.append(set(range(100)))
    left.append(set(range(45, 300)))  # 55 of 100 shared
    frames = [
        spark.createDataFrame([(k, h) for k, s in enumerate(sets_) for h in sorted(s)], "id bigint, h bigint") for sets_ in (left, right)
    ]
    for threshold, hot in ((0.0, 30), (0.55, 30), (0.55, 10**9), (0.28, 0), (1.0, 100)):
        found = so.overlaps(*frames, threshold, hot)
        got = {(r.job_id, r.document_id, r.overlap, r.query_n, r.reference_n) for r in fp.members(found).collect()}
        expected = {
            (i, j, len(a & b), len(a), len(b)) for i, a in enumerate(left) for j, b in enumerate(right)
            if a & b and max(len(a & b) / len(a), len(a & b) / len(b)) >= threshold
        }
        assert got == expected, threshold
        assert found.pairs.count() < len(expected)


def test_least_shared_is_the_comparison_itself(spark):
    rows = spark.range(1, 1200).select(F.col("id").alias("n"))
    for t in (0.05, 0.07, 0.1, 0.28, 0.29, 0.35, 0.55, 0.56, 0.57, 0.7, 0.99, 1.0):
        for n, k in rows.select("n", so.least_shared(F.col("n"), t)).collect():
            assert k / n >= t and (k == 1 or (k - 1) / n < t)


def test_a_passage_of_all_documents_makes_no_pairs_of_its_own(spark):
    """3,000 sets share 40 elements and have 300 of their own: the join makes no row a pair."""
    left = spark.range(3000).select("id", F.explode(F.concat(
        F.sequence(F.lit(-40), F.lit(-1)), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.col("id") * 1000 + k))).alias("h"))
    found = so.overlaps(left, left, 0.35)
    assert found.pairs.count() == 3000
    counted = found.pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in counted and "BroadcastNestedLoopJoin" not in counted


def test_copy_groups(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "job_id bigint, text string")
    registered = spark.createDataFrame([(7, "a"), (8, "a"), (9, "c")], "document_id bigint, text string").select(
        "document_id", tx.digest(F.col("text")).alias("exact_sha256"), F.lit(True).alias("enabled"))
    assert [tuple(r)[1:] for r in fp.copy_groups(docs, registered).collect()] == [(1, 2, 7, 2)]


def test_no_text_is_shuffled_for_paged_prints(spark):
    pages = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "d e f g h i j k")], "job_id bigint, page int, text string")
    plan = fp.paged_prints(pages)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan  # the pages were read once and written as words and prints
    parts = fp.page_parts(pages, 5, 4, "md5")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in parts


def test_elements_of_one_set_move_once(spark, monkeypatch):
    """Of 40 sets on both sides with 50 elements of their own and 3 common ones, few rows are kept."""
    rows = spark.createDataFrame([(n, 1000 * n + k) for n in range(40) for k in range(50)] + [(n, -k) for n in range(40) for k in range(1, 4)], "id bigint, h bigint")
    kept = {}

    def persist(df, name, write=so.persist_table):
        df = write(df, name)
        kept[name] = df.count()
        return df

    monkeypatch.setattr(so, "persist_table", persist)
    for hot_pairs in (10, 10_000):
        kept.clear()
        found = {(r.left, r.right): r.overlap for r in so.overlaps(rows, rows, 0.0, hot_pairs).pairs.collect()}
        assert found == {(a, b): 53 if a == b else 3 for a in range(40) for b in range(40)}
        assert sum(kept.values()) < 1000, kept


def registered_texts(spark):
    texts = [PROSE, PROSE, PROSE + " and more words that only this one has here", "quite another text of a dozen words that shares nothing with those"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "job_id long, text string")
    return docs, fp.register(docs.select(
        F.col("job_id").alias("document_id"), F.concat(F.lit("doc-"), "job_id").alias("name"), F.lit("o").alias("owner"),
        F.lit(7).alias("severity"), F.lit("hold").alias("action"), "text"))


def test_pairs_of_classes_carry_their_sizes(spark):
    """Pairs, far more than classes, are not moved to be joined with how many members these have."""
    docs, (registered, fingerprints) = registered_texts(spark)
    pairs, _, _ = fp.match_classes(docs, registered, fingerprints)
    assert {(r.job_class, r.document_class, r.jobs, r.documents) for r in pairs.collect()} == {
        (0, 0, 2, 2), (0, 2, 2, 1), (2, 0, 1, 2), (2, 2, 1, 1), (3, 3, 1, 1)}
    assert not [f for f in pairs.inputFiles() if "left-classes" in f or "right-classes" in f]


def test_columns_of_documents_join_before_pairs_are_made(spark):
    docs, (registered, fingerprints) = registered_texts(spark)
    found = fp.corpus_matches(docs, registered, fingerprints)
    assert {(r.job_id, r.document_id, r.document_name) for r in found.collect()} == {
        (a, b, f"doc-{b}") for a in range(3) for b in range(3)} | {(3, 3, "doc-3")}
    top = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "document_id" not in top
