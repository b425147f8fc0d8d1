"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from condfuse.plans.oracle import oracle_sql
from condfuse.plans.registry import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(oracle_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], oracle_sql()[name], SF_SMALL)
    assert r["cols"], (r["s_cols"], r["d_cols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["values"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 63 and "weighted_err_flow1" in df.columns
