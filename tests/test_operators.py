"""Operators on hand-made mini tables: branches the generated data misses
(FIXTURES.md §C)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from qtrlens.functions.expr import band_right_closed, floor1, ratio
from qtrlens.functions.windows import arg_best, pct_rank_avg, with_prev
from qtrlens.operators import insurance, pivots, signals, txn, users


def t1_rows(spark, rows):
    """rows: (state, year, quarter, type, count, amount)"""
    return spark.createDataFrame(
        [(s, y, q, t, c, Decimal(str(a))) for s, y, q, t, c, a in rows],
        "state string, year smallint, quarter int, transaction_type string, transaction_count bigint, "
        "transaction_amount decimal(20,2)")


def col(df, name):
    return [r[name] for r in df.collect()]


def test_percentile_and_sample_stddev(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    r = df.agg(F.percentile("x", 0.66).alias("p"), F.stddev_samp("x").alias("s")).first()
    assert r["p"] == pytest.approx(9.84)
    assert r["s"] == pytest.approx(8.80814017448254)


def test_percent_rank_average_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "v int")
    got = sorted(col(df.select(pct_rank_avg("v").alias("r")), "r"))
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_right_closed_bands(spark):
    xs = [-2.0, -1.9, -0.1, 0.0, 0.1, 0.3, 0.30001, 1.0, 1.1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    out = df.select("i", band_right_closed("x", insurance.PAGE_EDGES, insurance.PAGE_LABELS).alias("b")).orderBy("i")
    assert col(out, "b") == [None, "Low", "Low", "Medium", "Medium", "High", "Critical", "Critical", None]


def test_floor_keeps_null_and_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(0, None), (1, 0), (2, 5)], "i int, x bigint")
    assert col(df.orderBy("i").select(floor1("x").alias("f")), "f") == [None, 1, 5]
    assert spark.range(1).select(ratio(F.lit(5), F.lit(0)).alias("r")).first()["r"] is None


def test_arg_max_tie_takes_smallest_key(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "k string, v int")
    assert df.agg(arg_best("k", "v").alias("k")).first()["k"] == "a"
    assert df.agg(arg_best("k", "v", largest=False).alias("k")).first()["k"] == "c"


def test_pivot_mean(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 4.0)], "k string, c string, v double")
    p = pivots.pivot_matrix(df, ["k"], "c", "v", {"x": "x", "y": "why"}, agg="mean").collect()
    assert p[0]["x"] == 2.0 and p[0]["why"] == 0.0 and p[1]["x"] == 0.0


def test_pivot_raises_on_a_value_outside_the_list(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "z", 3.0)], "k string, c string, v double")
    with pytest.raises(Exception, match="outside the list: z"):
        pivots.pivot_matrix(df, ["k"], "c", "v", {"x": "x"}).collect()


def test_unmatched_users_and_null_brand_keep_their_rows(spark):
    t3 = spark.createDataFrame([("A", 2020, 1, 5, Decimal("9.00")), ("B", 2020, 1, 7, Decimal("3.00"))],
                               "state string, year smallint, quarter int, insurance_count bigint, insurance_amount decimal(20,2)")
    t2 = spark.createDataFrame([("A", 2020, 1, None, 4, 10, 20), ("A", 2020, 1, "x", 6, 10, 20)],
                               "state string, year smallint, quarter int, brand string, user_count bigint, registered_users bigint, app_opens bigint")
    got = {r["state"]: r["total_reg_users"] for r in insurance.insurance_penetration(t3, t2).collect()}
    assert got == {"A": 20, "B": None}
    assert [r["brand"] for r in users.brand_share(t2).collect()] == ["x"]


def test_lag_positional_vs_calendar(spark):
    df = spark.createDataFrame([(2020, 1, 10), (2020, 2, 20), (2020, 4, 40)], "year smallint, quarter int, v int")
    pos = with_prev(df, "v").orderBy("quarter")
    cal = with_prev(df, "v", calendar=True).orderBy("quarter")
    assert col(pos, "prev_v") == [None, 10, 20]
    assert col(cal, "prev_v") == [None, 10, None]


def test_two_quarter_decline(spark):
    t1 = t1_rows(spark, [("S", 2020, q, "P2P", 1, a) for q, a in [(1, 10), (2, 8), (3, 6), (4, 7)]])
    singles = txn.state_declines(t1)
    runs = txn.state_declines(t1, min_run=2)
    assert col(singles, "quarter") == [2, 3]
    assert col(runs, "quarter") == [3]


def test_priority_bands_sql_and_page_modes(spark):
    from qtrlens.functions.expr import band_at_least
    scores = [0.5, 0.2, 0.05, -0.2, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").orderBy("i")
    sql_mode = col(df.select(band_at_least("s", insurance.SQL_PRIORITY, "Low Priority").alias("b")), "b")
    assert sql_mode == ["Critical Priority", "High Priority", "Medium Priority", "Low Priority", "Low Priority"]
    page = col(df.select(band_right_closed("s", insurance.PAGE_EDGES, insurance.PAGE_LABELS).alias("b")), "b")
    assert page == ["Critical", "High", "Medium", "Low", None]


def test_hhi_bands(spark):
    rows = [("A", "d1", 100)]
    rows += [("B", "d1", 40), ("B", "d2", 30), ("B", "d3", 30)]
    rows += [("C", f"d{i}", 10) for i in range(10)]
    t4 = spark.createDataFrame([(s, d, 2020, 1, 1, Decimal(a)) for s, d, a in rows],
                               "state string, district string, year smallint, quarter int, "
                               "transaction_count bigint, transaction_amount decimal(20,2)")
    out = {r["state"]: (r["hhi_concentration_index"], r["distribution_type"]) for r in txn.district_hhi(t4).collect()}
    assert out["A"] == (1.0, "Highly Concentrated")
    assert out["B"] == (0.34, "Highly Concentrated")
    assert out["C"] == (0.1, "Well Distributed")


def test_anomaly_flags_single_outlier(spark):
    t1 = t1_rows(spark, [(f"S{i}", 2020, 1, "P2P", 1, 100) for i in range(9)] + [("S9", 2020, 1, "P2P", 1, 1000)])
    flagged = txn.ticket_anomaly(t1).where(F.col("fraud_signal") == "ANOMALY").collect()
    assert [r["state"] for r in flagged] == ["S9"]
    assert flagged[0]["z_score"] == pytest.approx(2.85, abs=0.01)
    assert [r["state"] for r in signals.flagged_states(t1).collect()] == ["S9"]


def test_user_grain_dedup_vs_rows(spark):
    t2 = spark.createDataFrame(
        [("S", 2020, 1, b, 10, 100, 500) for b in ["x", "y", "z"]],
        "state string, year smallint, quarter int, brand string, user_count bigint, registered_users bigint, "
        "app_opens bigint")
    rows_ = users.engagement_quarterly(t2, "rows").first()
    dedup = users.engagement_quarterly(t2, "deduped").first()
    assert rows_["total_registered"] == 300 and dedup["total_registered"] == 100
    assert rows_["engagement_ratio"] == dedup["engagement_ratio"] == 5.0


def test_kpi_registrations_literal_q1_compares_with_itself(spark):
    t8 = spark.createDataFrame(
        [("S", "d", None, 2020, 1, 50), ("S", None, "p", 2020, 1, 50), ("S", "d", None, 2019, 4, 25)],
        "state string, district string, pincode string, year smallint, quarter int, registered_users bigint")
    lit = users.kpi_registrations(t8, 2020, 1, literal_prev=True).first()
    cal = users.kpi_registrations(t8, 2020, 1).first()
    assert (lit["registrations"], lit["prev_registrations"], lit["growth_pct"]) == (100, 100, 0.0)
    assert (cal["prev_registrations"], cal["growth_pct"]) == (25, 300.0)
    assert cal["top_state"] == "S" and cal["top_district"] == "d"
    empty = users.kpi_registrations(t8, 2030, 1).first()
    assert empty["top_state"] == "N/A" and empty["registrations"] == 0


def test_decline_runs_of_three(spark):
    amounts = [10, 9, 8, 7, 8, 7]
    t1 = t1_rows(spark, [("S", 2020 + i // 4, i % 4 + 1, "P2P", 1, a) for i, a in enumerate(amounts)])
    got = [(r["year"], r["quarter"]) for r in txn.state_declines(t1, min_run=3).collect()]
    assert got == [(2020, 4)]


def test_calendar_lag_over_a_missing_year(spark):
    df = spark.createDataFrame([(2019, 1), (2020, 2), (2022, 4)], "year smallint, v int")
    cal = with_prev(df, "v", order=["year"], calendar=True).orderBy("year")
    assert col(cal, "prev_v") == [None, 1, None]
    g = users.user_growth_yoy(spark.createDataFrame(
        [("S", 2019, 1, "b", 1, 100, 1), ("S", 2020, 1, "b", 1, 150, 1), ("S", 2022, 1, "b", 1, 300, 1)],
        "state string, year smallint, quarter int, brand string, user_count bigint, registered_users bigint, "
        "app_opens bigint"), calendar=True)
    assert col(g, "yoy_growth_pct") == [None, 50.0, None]
