"""Every query against its SQL twin, and the entry module's contract."""

import pytest

import __spark_entry__ as entry
from camloom.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    got, expected = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 19
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
