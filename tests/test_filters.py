"""Selection filters (F1-F10) and loader aggregation (S13/S15)."""

from decimal import Decimal

from qtrlens import sinks
from qtrlens.operators import filters


def _t1(spark):
    rows = [(s, y, q, "P2P", 1, Decimal("10.00")) for s in ["B", "A", "C"] for y in [2019, 2020, 2021]
            for q in [1, 2, 3, 4]]
    return spark.createDataFrame(rows, "state string, year smallint, quarter int, transaction_type string, "
                                       "transaction_count bigint, transaction_amount decimal(20,2)")


def test_select_years_states_and_empty_means_all(spark):
    t1 = _t1(spark)
    assert filters.select_years_states(t1, [2020], ["A", "B"]).count() == 8
    assert filters.select_years_states(t1, [], None).count() == t1.count()


def test_newest_years_semi_join(spark):
    t1 = _t1(spark)
    got = sorted({r["year"] for r in filters.select_newest_years(t1, 2).collect()})
    assert got == [2020, 2021]


def test_period_range_crosses_years(spark):
    t1 = _t1(spark)
    got = sorted({(r["year"], r["quarter"]) for r in filters.period_range(t1, (2019, 3), (2020, 2)).collect()})
    assert got == [(2019, 3), (2019, 4), (2020, 1), (2020, 2)]


def test_natural_key_totals_adds_up_appended_copies(spark):
    t1 = _t1(spark)
    doubled = sinks.natural_key_totals(t1.unionByName(t1), "aggregated_transaction")
    r = doubled.where("state = 'A' and year = 2020 and quarter = 1").first()
    assert r["transaction_count"] == 2 and r["transaction_amount"] == Decimal("20.00")
    assert doubled.count() == t1.count()
