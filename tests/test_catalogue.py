"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from loam.plans.all import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
