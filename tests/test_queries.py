"""Every query of the engine against its SQL twin."""

import pytest

from oracle import connect, same
from tallyloom.plans.registry import ORACLE, QUERIES
from tests_data import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
