"""Every query of the library against DuckDB, on the smallest tables."""

import os

import pytest

from loomwork import plans
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE:
        assert compare(df, con, plans.ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "loomwork"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "loomwork.llm" not in f.read_text()
