"""Scalar helpers (C1-C21) and session rules."""

import pytest
from pyspark.sql import functions as F

from qtrlens.functions import expr as X
from qtrlens.plans.sqlx import half_up_rounds


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_units_and_formats(spark):
    assert one(spark, X.crore(F.lit(123456789))) == pytest.approx(12.3456789)
    assert one(spark, X.fmt_crore(F.lit(123456789))) == "₹12.35 Cr"
    assert one(spark, X.fmt_crore(F.lit(123456789), 1)) == "₹12.3 Cr"
    assert one(spark, X.fmt_lakh(F.lit(1234567))) == "12.35 L"
    assert one(spark, X.fmt_million(F.lit(2500000))) == "2.50M"
    assert one(spark, X.fmt_rupees(F.lit(1234567.4))) == "₹1,234,567"


def test_labels_and_text(spark):
    df = spark.createDataFrame([(2020, 1, "andaman-&-nicobar-islands", "Peer-to-peer payments")],
                               "year smallint, quarter int, slug string, name string")
    r = df.select(X.period().alias("p"), X.ordinal().alias("o"), X.slug_to_title("slug").alias("t"),
                  X.first_word("name").alias("w")).first()
    assert (r["p"], r["o"], r["t"], r["w"]) == ("2020 Q1", 8081, "Andaman & Nicobar Islands", "Peer-to-peer")


def test_growth_share_change_guarded(spark):
    assert one(spark, X.pct_growth(F.lit(110), F.lit(100))) == pytest.approx(10.0)
    assert one(spark, X.pct_growth(F.lit(110), F.lit(0))) is None
    assert one(spark, X.share_pct(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, X.pct_change(F.lit(150), F.lit(100))) == pytest.approx(50.0)
    assert one(spark, X.pct_growth_floor1(F.lit(5), F.lit(0))) == 500.0
    assert one(spark, X.sign_flag(F.lit(-0.5))) == "below"


def test_half_up_rounding_matches_spark(spark):
    # 199 / 40 = 4.975: Spark rounds the decimal form half-up; the oracle rewrite does too
    assert one(spark, F.round(F.lit(199.0) / F.lit(40.0), 2)) == 4.98
    sql = half_up_rounds("select round(199.0::double / 40.0::double, 2) as v")
    import duckdb
    assert duckdb.connect().execute(sql).fetchone()[0] == 4.98


def test_checkpoint_dir_is_read_not_overridden(spark):
    from qtrlens.session import ensure_checkpoint_dir
    first = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert ensure_checkpoint_dir(spark) == first and (named is None or first == named)


def test_scratch_folders_name_their_file_system(spark):
    from qtrlens.session import qualified, scratch_path
    assert qualified(spark, "/some/where") == "file:/some/where" and qualified(spark, "file:/some/where") == "file:/some/where"
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith("file:/")
