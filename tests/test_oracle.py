"""Every registered query against its DuckDB oracle (rows-only when no SQL) at sf0.001."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from cohortlens.plans import catalog
from oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_named_and_most_have_oracles():
    assert len(QUERIES) >= 150
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    fn = QUERIES[name]
    if name in ORACLE:
        assert compare(spark, con, name, fn, ORACLE[name], SF) == []
    else:
        assert fn(spark, SF).count() > 0
