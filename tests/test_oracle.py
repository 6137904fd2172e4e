"""Every registered query with SQL, on the smallest tables, against that SQL."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, oracle_connection

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert compare(ours, con.execute(SQL[name]).df()) is None


def entry_ticks(spark):
    """Ticks of six hours with 72 h of events before and 24 h after."""
    tick, hour = 6 * 3600, 3600
    lo, hi = spark.read.parquet(f"{SF}/events.parquet").filter("event_type <> 'error'").selectExpr(
        "min(unix_micros(CAST(ts AS TIMESTAMP)))", "max(unix_micros(CAST(ts AS TIMESTAMP)))").first()
    first = -(-(lo + 72 * hour * 10**6) // (tick * 10**6))
    return (hi - 24 * hour * 10**6) // (tick * 10**6) - first + 1


def test_entry(spark):
    df = entry.entry(spark)
    ticks = entry_ticks(spark)
    assert df.count() == 15 * ticks and ticks > 95
    assert {"target_outage", "weather_count_72h", "compound_severity_index"} <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
