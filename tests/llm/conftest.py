import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def texts(sf):
    """Documents and benchmark items as dictionaries."""
    con = duckdb.connect()
    return tuple(
        dict(con.execute(f"SELECT {k}, text FROM '{sf}/{t}.parquet'").fetchall())
        for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))
    )


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: doc_id, text: nulls, empty and very long texts, ties, repeated rows.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, "no id at all"), (6, "short"),
    (7, "ÄÖ ß 日本語 \U0001f600 text"), (2**60 + 1, "a b c d e f"), (2**60 + 2, "a b c d e f"), (8, None),
]


@pytest.fixture
def awkward(spark):
    """The awkward rows with extra columns whose names operators use themselves."""
    rows = [(i, t, "x", 1.5, True, None) for i, t in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, class string, score double, kept boolean, first string"
    )


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
