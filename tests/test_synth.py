"""Synthetic demo tables: row counts, ranges, invariants; operators run on them."""

from pyspark.sql import functions as F

from qtrlens.operators import insurance, txn, users
from qtrlens.sources import synth


def test_demo_tables_shape_and_ranges(spark):
    t1 = synth.demo_transactions(spark)
    assert t1.count() == 1000
    r = t1.agg(F.min("transaction_count"), F.max("transaction_count"),
               F.min("transaction_amount"), F.max("transaction_amount")).first()
    assert 1000 <= r[0] and r[1] < 50000 and 5_000_000 <= r[2] and r[3] < 500_000_000
    t2 = synth.demo_users(spark)
    assert t2.count() == 1600
    per_sq = t2.groupBy("state", "year", "quarter").agg(F.count_distinct("registered_users").alias("n"))
    assert per_sq.where("n > 1").count() == 0
    assert synth.demo_insurance(spark).count() == 200
    assert synth.demo_top_states(spark).count() == 10


def test_case_tables_shape(spark):
    assert synth.case_transactions(spark).count() == 1500
    assert synth.case_users(spark).count() == 2400
    assert synth.case_insurance(spark).count() == 300
    assert synth.case_map(spark).count() == 900
    reg = synth.case_registrations(spark)
    assert reg.count() == 900
    per = reg.groupBy("state", "year", "quarter").agg(F.count_distinct("district").alias("d"))
    assert per.where("d <> 3").count() == 0
    assert reg.select("pincode").distinct().count() <= 30


def test_case_growth_trend_and_determinism(spark):
    t1 = synth.case_transactions(spark)
    y = {r["year"]: r["a"] for r in t1.groupBy("year").agg(F.sum("transaction_amount").alias("a")).collect()}
    assert y[2024] > y[2020]
    assert sorted(t1.collect()) == sorted(synth.case_transactions(spark).collect())


def test_operators_run_on_synthetic(spark):
    t = synth.SyntheticTables(spark)
    assert txn.txn_category_qoq(t.aggregated_transaction).count() == 100
    assert users.kpi_users(t.aggregated_user).first()["top_brand"] == "Samsung"
    assert insurance.insurance_opportunity(t.aggregated_insurance, t.aggregated_user).count() == 15
    assert txn.district_hhi(t.map_transaction).count() == 15
    assert users.reg_top(t.top_user, 2024, 4).count() == 10


def test_open_tables_switch(spark):
    from qtrlens.sources.tables import open_tables
    syn = open_tables(spark, "synthetic")
    assert syn.aggregated_transaction.count() == 1500
    der = open_tables(spark, "derived", "/root/testdata/sf0.001")
    assert der.aggregated_insurance.count() > 0
