from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    from veilscan.session import prepare

    return prepare(session())


@pytest.fixture
def pages(spark):
    """Builds pages(job_id, page, text) from texts."""

    def build(*texts):
        return spark.createDataFrame(
            [(n, 1, text) for n, text in enumerate(texts)], "job_id bigint, page int, text string"
        )

    return build
