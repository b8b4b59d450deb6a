"""Every registered query against its SQL, and against plans that would not scale."""

import pytest

from checks.all import ORACLES, QUERIES
from checks.compare import difference


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, small, duck_small, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, duck_small, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
