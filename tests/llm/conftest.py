from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LOWER_AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small inputs: most of the time of these tests is the start of tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds documents from (doc_id, text[, lang[, source]]) rows, with a clashing extra column."""

    def build(rows, extra="score double, part string"):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), 0.5, "x") for r in full]
        return spark.createDataFrame(full, f"{SCHEMA}, {extra}").repartition(2)

    return build


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


#: Nulls, empty texts, repeated rows, copies, a very long text.
EDGES = [
    (None, None), (None, "lone text of a row without id and some more words"), (1, None), (2, ""), (3, " \t\n"),
    (4, "one"), (5, "one"), (5, "one"), (6, " ".join(prose(1, 120))), (7, " ".join(prose(1, 120))),
    (7, " ".join(prose(1, 120))), (8, " ".join(prose(2, 30000, 5000))), (9, "ÀÉ ñandú ß"), (10, " a b"),
]


@pytest.fixture
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture
def nothing(docs_of, spark):
    return spark.createDataFrame([], docs_of([(1, "a")]).schema)
