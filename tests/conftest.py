import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from auditlake import build_session

    session = build_session(
        app="auditlake-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="3g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture()
def lines(spark):
    """Turn Python strings into a ``(pos, file, block_start, rid, line)`` table."""

    def make(texts, file="f"):
        rows = [(i, file, 0, i, t) for i, t in enumerate(texts)]
        schema = "pos bigint, file string, block_start bigint, rid bigint, line string"
        return spark.createDataFrame(rows, schema)

    return make
