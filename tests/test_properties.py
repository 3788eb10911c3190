"""Invariants of the derived tables and result sets."""

import pytest
from pyspark.sql import functions as F

from qtrlens.operators import txn, users
from qtrlens.sources.fixtures import DerivedTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return DerivedTables(spark, SF)


def test_users_constant_per_state_quarter(t):
    bad = (t.aggregated_user.groupBy("state", "year", "quarter")
           .agg(F.count_distinct("registered_users").alias("r"), F.count_distinct("app_opens").alias("o"))
           .where((F.col("r") > 1) | (F.col("o") > 1)))
    assert bad.count() == 0


def test_state_totals_equal_district_totals(t):
    a = t.aggregated_transaction.agg(F.sum("transaction_amount")).first()[0]
    m = t.map_transaction.agg(F.sum("transaction_amount")).first()[0]
    assert a == m


def test_top_tier_levels_cover_same_activity(t):
    top = t.top_transaction
    d = top.where(F.col("pincode").isNull()).agg(F.sum("transaction_amount")).first()[0]
    p = top.where(F.col("pincode").isNotNull()).agg(F.sum("transaction_amount")).first()[0]
    assert d == p


def test_shares_sum_to_100(t):
    s = txn.category_performance(t.aggregated_transaction).agg(F.sum("amount_share_pct")).first()[0]
    assert s == pytest.approx(100.0, abs=0.05)
    b = users.brand_share(t.aggregated_user).agg(F.sum("market_share_pct")).first()[0]
    assert b == pytest.approx(100.0, abs=0.05)


def test_lag_chain_reproduces_totals(t):
    q = txn.trend_qoq(t.aggregated_transaction).collect()
    for prev, cur in zip(q, q[1:]):
        assert cur["prev_amount"] == prev["total_amount"]
