"""Physical plan checks: no Python in the hot path, no cartesian products, filters
and column pruning reach the Parquet scans."""

import pytest

import __spark_entry__ as E
from qtrlens.sources.fixtures import DerivedTables

SF = "/root/testdata/sf0.001"
BAD_NODES = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "PythonUDF"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_python_udf_or_cartesian(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    for node in BAD_NODES:
        assert node not in text, f"{name}: {node} in plan"


def test_filters_and_pruning_reach_scan(spark):
    from qtrlens.operators import users
    t = DerivedTables(spark, SF)
    df = users.reg_top(t.top_user, 2000, 4)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text
    # only the needed order columns are read
    assert "o_comment" not in text and "o_orderstatus" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in text or \
        "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_nation_dimension_is_broadcast(spark):
    t = DerivedTables(spark, SF)
    text = t.aggregated_transaction._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in text.lower()


def test_two_grain_tables_scan_once(spark):
    """top_* use grouping sets: a single Expand, no Union; aggregated_user needs neither."""
    t = DerivedTables(spark, SF)
    for name in ["top_transaction", "top_user", "top_insurance"]:
        text = t.table(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" in text and "Union" not in text, name
    text = t.aggregated_user._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text and "Union" not in text and text.count("lineitem.parquet") <= 1
    assert "distinct" not in t.aggregated_user._jdf.queryExecution().executedPlan().toString()


def test_who_reads_brands_only_pays_for_brands_only(spark):
    t = DerivedTables(spark, SF)
    text = t.aggregated_user.select("state", "brand", "user_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "row_number" not in text


def test_aggregates_are_partial_before_shuffle(spark):
    """Map-side combine: a hot key costs one row per task in the shuffle."""
    t = DerivedTables(spark, SF)
    for name in ["aggregated_transaction", "top_transaction", "aggregated_user", "user_totals"]:
        text = t.table(name)._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in text, name
