"""The stages one after the other, and the list of queries."""

from __future__ import annotations

import corpus_pipeline
from veilscan.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_complete():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen[1] == seen[0] == seen[2] > seen[3] > seen[4]
    assert set(docs.columns) == {*columns, "epoch"}


def test_queries_match_sql(spark):
    import check_sql

    for name, sql in SQL.items():
        got = QUERIES[name](spark, FOLDER).toPandas()
        assert check_sql.difference(got, check_sql.connect(FOLDER).execute(sql).df()) == "", name


CLASHES = {
    "language_id": ("score", "lang_pred", "Ambiguous"), "line_dedup": ("_key", "_hash", "_gone", "_row"),
    "near_dedup": ("_id", "_print", "print", "component_id"), "decontamination": ("items", "best_score", "first_word"),
    "mixing": ("domain", "n_tokens", "_whole", "epoch"),
}


def test_stages_keep_the_values_of_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        more = docs.selectExpr("*", *[f"concat('{c} of ', doc_id) AS `{c}`" for c in CLASHES[name]])
        rows = stage(spark, more, FOLDER).collect()
        assert rows, name
        for row in rows:
            assert all(row[c] == f"{c} of {row['doc_id']}" for c in CLASHES[name]), name
