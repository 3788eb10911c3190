"""Ranks, percentiles and matrices without a window over all rows; tables derived once or in part."""

import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qtrlens.functions import ranks
from qtrlens.operators import pivots, places
from qtrlens.sources.fixtures import DerivedTables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3, rng.randint(0, 400)])) for i in range(3_000)]
    return rows, spark.createDataFrame(rows, "id long, v long").repartition(7).cache()


def test_positions_number_all_rows(values):
    rows, df = values
    got = ranks.global_positions(df, [F.col("v").desc_nulls_last(), F.col("id").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("descending", [False, True])
def test_value_ranks_count_ties(values, descending):
    rows, df = values
    v = [x for _, x in rows if x is not None]
    got = {r.v: (r.n, r.before, r.total) for r in ranks.value_ranks(df, "v", descending).collect()}
    assert got == {x: (v.count(x), sum((y > x) if descending else (y < x) for y in v), len(v)) for x in set(v)}


def test_percent_ranks_are_those_of_pandas(values):
    rows, df = values
    got = {r.id: r.pct_rank for r in ranks.with_percent_rank(df, "v").collect()}
    want = pd.Series([x for _, x in rows], dtype="float64").rank(pct=True)
    for (i, x), w in zip(rows, want):
        assert (got[i] is None) if x is None else got[i] == pytest.approx(w, abs=1e-12)


def test_percentiles_are_exact(values, spark):
    rows, df = values
    v = pd.Series([x for _, x in rows if x is not None], dtype="float64")
    shares = [0.0, 0.25, 0.66, 0.9, 0.999, 1.0]
    got = ranks.percentiles(df, "v", shares).first()
    assert list(got) == pytest.approx([v.quantile(q) for q in shares])
    assert ranks.percentiles(df.where("false"), "v", [0.5]).first()[0] is None
    assert ranks.percentiles(spark.createDataFrame([(2,), (5,)], "v long"), "v", [0.5]).first()[0] == 3.5


def test_a_value_that_most_rows_share_is_one_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("v"))
    got = ranks.value_ranks(df, "v").where("v = 7").first()
    assert got.n == 18_000 + (7 % 10 == 9) and got.total == 20_000


def test_no_window_over_all_places(spark):
    t = DerivedTables(spark, SF)
    rows = t.top_level("top_transaction", "pincode")
    for make in (places.place_segments, places.place_shares):
        text = plan(make(rows))
        assert "Window" not in text.split("Subquery")[0], make.__name__
    # windows that remain see a row per partition or one partition's values
    for make in (places.place_ranking, places.place_percent_ranks):
        text = plan(make(rows))
        assert "SinglePartition" not in text or "__part" in text, make.__name__


def test_the_total_of_shares_uses_the_same_exchange(spark):
    t = DerivedTables(spark, SF)
    from qtrlens.operators import signals
    text = final_plan(signals.topk_share(t.aggregated_transaction))
    assert "Reused" in text


def test_open_matrix_has_every_period_in_every_row(spark):
    df = spark.createDataFrame([("a", "2020 Q1", 1.0), ("a", "2021 Q3", None), ("b", "2020 Q4", 2.5), ("c", None, 9.0)], "k string, p string, v double")
    got = {r.k: r.cells for r in pivots.open_matrix(df, ["k"], "p", "v").collect()}
    assert got == {"a": {"2020 Q1": 1.0, "2020 Q4": 0.0, "2021 Q3": 0.0}, "b": {"2020 Q1": 0.0, "2020 Q4": 2.5, "2021 Q3": 0.0}}
    keys = pivots.open_matrix(df, ["k"], "p", "v").select(F.map_keys("cells").alias("k")).collect()
    assert all(r.k == ["2020 Q1", "2020 Q4", "2021 Q3"] for r in keys)
    bare = {r.k: r.cells for r in pivots.cells_text(pivots.open_matrix(df, ["k"], "p", "v", fill=None)).collect()}
    assert bare == {"a": "2020 Q1=1.00;2020 Q4=-;2021 Q3=-", "b": "2020 Q1=-;2020 Q4=2.50;2021 Q3=-"}


def test_open_and_closed_matrices_agree(spark):
    t = DerivedTables(spark, SF)
    closed = {(r.transaction_type, r.year, q): r[f"q{q}"] for r in pivots.category_period_matrix(t.aggregated_transaction).collect() for q in (1, 2, 3, 4)}
    cells = {(r.transaction_type, int(p[:4]), int(p[-1])): v for r in pivots.category_by_period(t.aggregated_transaction).collect() for p, v in r.cells.items()}
    assert all(closed.get(k, 0.0) == pytest.approx(v) for k, v in cells.items())


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_tables_derived_once_are_the_tables(spark):
    t = DerivedTables(spark, SF)
    once = t.once()
    for name in ("aggregated_user", "aggregated_insurance", "user_totals"):
        assert rows_of(getattr(once, name).select(*getattr(t, name).columns)) == rows_of(getattr(t, name)), name
    text = plan(once.aggregated_user.join(once.aggregated_insurance, ["state", "year", "quarter"]))
    assert "lineitem" not in text  # both come from the checkpoint


def test_the_newest_years_bound_the_order_scan(spark, tmpdir_fresh):
    t = DerivedTables(spark, SF)
    recent = t.newest(2, t.transaction_years)
    years = sorted({r.year for r in t.aggregated_transaction.select("year").distinct().collect()})[-2:]
    for name in ("aggregated_transaction", "aggregated_insurance", "top_transaction"):
        assert rows_of(recent.table(name)) == rows_of(t.table(name).where(F.col("year").isin(years))), name
    text = recent.aggregated_insurance._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("make_date(") > text.rindex("Join Inner")  # a filter of the orders alone, below the joins
    stored = t.materialize(f"{tmpdir_fresh}/tables", ["aggregated_transaction"])
    some = stored.newest(1, stored.transaction_years).aggregated_transaction
    assert rows_of(some) == rows_of(t.aggregated_transaction.select(*some.columns).where(F.col("year") == years[-1]))
    scan = plan(some)
    assert "PartitionFilters: [isnotnull(year" in scan and "year" in scan.split("PartitionFilters:")[1].split("]")[0] and "ubquery" in scan


def test_median_of_an_even_number(spark):
    v = [5, 1, 9, 4]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    assert ranks.percentiles(df, "v", [0.5]).first()[0] == statistics.median(v)
