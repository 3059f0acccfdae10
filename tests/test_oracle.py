"""Every query with SQL gives the SQL's rows."""

import pytest

from lodestitch.plans import registry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert not differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF, con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
