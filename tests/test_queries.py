"""Every registered telemetry query against its SQL."""

import pytest

from sensorloom import plans
from tests.compare import SF, connection, difference

SQL = plans.oracle_sql()
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    found = difference(spark, con, plans.queries()[name], SQL[name])
    if found == "no rows":  # at the smallest scale a filter may leave nothing on both sides
        found = difference(spark, connection(LARGER), plans.queries()[name], SQL[name], LARGER)
    assert found == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_query_without_sql_runs_twice_alike(spark, name):
    q = plans.queries()[name]
    rows = lambda: sorted(map(str, q(spark, SF).collect()))
    first = rows()
    assert first and first == rows()


def test_no_nested_loops(spark):
    for name in ("j1_nearest_within_tolerance", "j3_zero_order_hold", "j6_linear_interpolation", "j15_nearest_point", "j16_polyline_projection", "flagship"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
