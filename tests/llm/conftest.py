import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from conftest_llm import ROWS  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with extra columns whose names the operators use themselves."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    rows = [(i, t, None, "src0", 1.0, "x", 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, digest string, h int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)
