"""Matrix result sets (heatmaps): an aggregate pivoted on a closed list of values, or keyed by
whatever values there are.

``groupBy(index).pivot(column, values)`` is one lazy aggregate with a column per value. The
quarters are four, and the year is part of the index, so the width does not grow with the
calendar; brands are given by the caller. A value outside the list is an error, not a loss.
``open_matrix`` has a map of cells per row instead: type x period and state x period as they
are shown, over a calendar of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.functions.aggs import sum_count, sum_money
from qtrlens.functions.expr import crore, pct_growth, period

AGGS = {"sum": F.sum, "mean": F.avg, "first": F.first}


QUARTERS = {1: "q1", 2: "q2", 3: "q3", 4: "q4"}


def pivot_matrix(df: DataFrame, index: Sequence[str], column: str, value: str, values: dict,
                 agg: str = "sum", fill: float | None = 0.0) -> DataFrame:
    """Rows = ``index``, one column per key of ``values`` (value -> column name); missing cells
    ``fill``ed (None keeps NULL). ``agg='mean'`` is the pandas ``pivot_table`` default. Rows
    with a NULL in ``column`` belong to no cell; a value that isn't listed raises."""
    src = df.where(F.col(column).isNotNull())
    known = F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} outside the list: "), F.col(column).cast("string"))).cast(src.schema[column].dataType))
    p = src.withColumn(column, known).groupBy(*index).pivot(column, list(values)).agg(AGGS[agg](value))
    p = p.select(*index, *[F.col(f"`{k}`").alias(name) for k, name in values.items()])
    if fill is not None:
        p = p.na.fill(fill, subset=list(values.values()))
    return p.orderBy(*index)


def open_matrix(df: DataFrame, index: Sequence[str], column: str, value: str, fill: float | None = 0.0) -> DataFrame:
    """Rows = ``index``, and ``cells``: a map from every value of ``column`` that ``df`` has, in order, to
    the row's ``value`` (``fill`` where it has none; None keeps NULL). ``df`` has a row per cell.

    One aggregate, and a scalar subquery for the values: no list is given and none is collected to
    the driver, so a longer calendar makes longer maps, not another plan."""
    src = df.where(F.col(column).isNotNull())
    values = src.agg(F.array_sort(F.collect_set(column)).alias("v")).scalar()
    rows = src.groupBy(*index).agg(F.map_from_entries(F.collect_list(F.struct(column, value))).alias("__cells")).withColumn("__values", values)
    cell = lambda v: F.try_element_at(F.col("__cells"), v)
    filled = F.transform("__values", (lambda v: cell(v)) if fill is None else (lambda v: F.coalesce(cell(v), F.lit(fill))))
    return rows.select(*index, F.map_from_arrays("__values", filled).alias("cells"))


def cells_text(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """``matrix`` with its cells as text (``2020 Q1=1.50;...``, a NULL as ``-``) and their number."""
    shown = F.transform(F.map_entries("cells"), lambda e: F.when(e["value"].isNull(), F.concat(e["key"], F.lit("=-"))).otherwise(
        F.concat(e["key"], F.lit("="), F.format_string(f"%.{digits}f", F.round(e["value"], digits)))))
    return matrix.select(*[c for c in matrix.columns if c != "cells"], F.size("cells").cast("bigint").alias("periods"),
                         F.array_join(shown, ";").alias("cells"))


def category_by_period(t1: DataFrame) -> DataFrame:
    """Category x period amount (crore), 0 where there are no rows."""
    q = t1.groupBy("transaction_type", period().alias("period")).agg(sum_money("transaction_amount", "amount"))
    return open_matrix(q.select("transaction_type", "period", crore("amount").alias("v")), ["transaction_type"], "period", "v")


def category_qoq_by_period(t1: DataFrame) -> DataFrame:
    """Category x period QoQ % (1 dp); NULL in each category's first quarter and where it has none."""
    q = t1.groupBy("year", "quarter", "transaction_type").agg(sum_money("transaction_amount", "amount"))
    w = Window.partitionBy("transaction_type").orderBy("year", "quarter")
    q = q.select("transaction_type", period().alias("period"), F.round(pct_growth("amount", F.lag("amount").over(w)), 1).alias("v"))
    return open_matrix(q, ["transaction_type"], "period", "v", fill=None)


def state_by_period(t4: DataFrame) -> DataFrame:
    """State x period amount (crore) of the map tier, 0 fill."""
    q = t4.groupBy("state", period().alias("period")).agg(sum_money("transaction_amount", "amount"))
    return open_matrix(q.select("state", "period", crore("amount").alias("v")), ["state"], "period", "v")


def reg_growth_by_period(t8: DataFrame) -> DataFrame:
    """State x period registration growth % (mean per cell, then 0 fill)."""
    from qtrlens.operators.users import reg_trend
    q = reg_trend(t8).groupBy("state", period().alias("period")).agg(F.avg("growth_pct").alias("v"))
    return open_matrix(q, ["state"], "period", "v")


def category_period_matrix(t1: DataFrame) -> DataFrame:
    """Category and year x quarter amount (crore), 0 where there are no rows."""
    q = (t1.groupBy("year", "quarter", "transaction_type").agg(sum_money("transaction_amount", "amount"))
         .select("transaction_type", "year", "quarter", crore("amount").alias("amount_cr")))
    return pivot_matrix(q, ["transaction_type", "year"], "quarter", "amount_cr", QUARTERS)


def category_qoq_matrix(t1: DataFrame) -> DataFrame:
    """Category and year x quarter QoQ % (1 dp); the first quarter of each category stays NULL."""
    q = t1.groupBy("year", "quarter", "transaction_type").agg(sum_money("transaction_amount", "amount"))
    w = Window.partitionBy("transaction_type").orderBy("year", "quarter")
    q = q.withColumn("qoq_pct", F.round(pct_growth("amount", F.lag("amount").over(w)), 1))
    return pivot_matrix(q, ["transaction_type", "year"], "quarter", "qoq_pct", QUARTERS, agg="first", fill=None)


def state_brand_matrix(t2: DataFrame, brands: Sequence[str]) -> DataFrame:
    """State x brand device users, 0 where a brand is absent."""
    b = t2.groupBy("state", "brand").agg(sum_count("user_count", "user_count"))
    return pivot_matrix(b, ["state"], "brand", "user_count", {x: x for x in brands}, fill=0)


def state_period_matrix(t4: DataFrame) -> DataFrame:
    """State and year x quarter amount (crore) of the map tier, 0 fill."""
    q = (t4.groupBy("state", "year", "quarter").agg(sum_money("transaction_amount", "amount"))
         .select("state", "year", "quarter", crore("amount").alias("amount_cr")))
    return pivot_matrix(q, ["state", "year"], "quarter", "amount_cr", QUARTERS)


def reg_growth_matrix(t8: DataFrame) -> DataFrame:
    """State and year x quarter registration growth % (mean per cell, then 0 fill)."""
    from qtrlens.operators.users import reg_trend
    return pivot_matrix(reg_trend(t8), ["state", "year"], "quarter", "growth_pct", QUARTERS, agg="mean")
