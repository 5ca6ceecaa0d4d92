import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture()
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with extra columns that clash with names used inside."""

    def make(rows):
        clashing = "id long, kept boolean, n long, key string, digest string, spans string, score double"
        values = [(i, t, None, True, 7, "k", "d", "s", 0.5) for i, t in rows]
        frame = spark.createDataFrame(values, f"doc_id long, text string, {clashing}")
        return frame.repartition(3)

    return make
