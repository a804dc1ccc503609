"""Every registered query against its SQL on the driver tables."""

from __future__ import annotations

import __spark_entry__ as contract
import pytest

from testbed.catalog import QUERIES, STUDY_SIZE
from testbed.oracles import ORACLES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def sql_engine(medium):
    return connect(medium)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STUDY_SIZE)))
def test_query_matches_sql(spark, medium, sql_engine, name):
    expected = sql_engine.sql(ORACLES[name]).to_arrow_table()
    actual = QUERIES[name](spark, medium).toArrow()
    assert actual.num_rows > 0
    assert difference(actual, expected) is None


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 120


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | set(STUDY_SIZE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
