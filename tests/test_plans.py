"""Plan checks on every registered query, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tallyspark.plans import catalog

SF_SMALL = "/root/testdata/sf0.001"

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
             "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas", "MapInPandas"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_keys_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["account_id", "Month", "Income", "Expenses", "Savings", "SavingsRate"]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_or_cartesian(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_top_k_uses_group_limit(spark):
    plan = _plan(entry.queries()["top_transactions"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_scan_prunes_and_pushes(spark):
    df = entry.queries()["monthly_summary"](spark, SF_SMALL)
    plan = _plan(df)
    assert "IsNotNull(o_orderdate)" in plan
    assert "o_custkey" in plan and "o_clerk" not in plan
    schema = [ln for ln in df._jdf.queryExecution().executedPlan().toString().split("\n")
              if "ReadSchema" in ln]
    assert schema and all("o_orderkey" not in s for s in schema)


@pytest.mark.parametrize("name", ["top_transactions", "hot_account_top_transactions"])
def test_top_k_limits_before_the_shuffle(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Partial limit under the exchange, final limit after it.
    assert plan.count("WindowGroupLimit") >= 2


def test_hot_account_aggregates_partially(spark):
    plan = _plan(entry.queries()["hot_account_kpi_summary"](spark, SF_SMALL))
    assert "partial_sum" in plan
