"""Every corpus query with SQL gives the SQL's rows."""

import pytest

from lodestitch.llm import queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert not differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF, con)
