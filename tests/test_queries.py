"""Every registered query of the library against its SQL."""

import pytest
from oracle import compare
from quire.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    assert compare(spark, data, QUERIES[name], SQL.get(name)) == "ok"
