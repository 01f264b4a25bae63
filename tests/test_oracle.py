"""Every registered query gives what plain SQL gives on another engine."""

import pytest

import __spark_entry__ as entry_points
from tablegauge.plans import oracle, registry
from tests.compare import connect, difference
from tests.conftest import SMALL

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(registry.all_queries()) == set(oracle.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) is None


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert "consumption_readiness_score" in frame.columns and frame.count() > 0
