import pytest

from tessera.plans.catalog import ORACLES, QUERIES
from tests.oracle import same

#: The report runs some thirty jobs; the others with SQL are compared with it.
SLOW = {"evaluation_report"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    same(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
