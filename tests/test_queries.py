"""Every registered query against its oracle SQL on the smallest scale."""

import pytest

import basisflow.queries  # noqa: F401
from basisflow.queries.registry import ORACLES, QUERIES
from tests.harness import diff, duck, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, got = rows_of_spark(QUERIES[name](spark, SF))
    assert got, "no rows"
    if name in ORACLES:
        ocols, want = rows_of_sql(con, ORACLES[name])
        assert cols == ocols
        assert len(got) == len(want)
        assert got == want, diff(got, want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
