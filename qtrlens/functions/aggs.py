"""Aggregate expressions with fixed result types.

Money sums are widened to decimal(38,2) (Spark's own sum would be decimal(30,2));
count sums are bigint. Fixed types keep schemas stable across inputs and engines,
and 38 digits leave room for national totals at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_SUM = "decimal(38,2)"


def sum_money(c: str, alias: str | None = None) -> Column:
    e = F.sum(c).cast(MONEY_SUM)
    return e.alias(alias) if alias else e


def sum_count(c: str, alias: str | None = None) -> Column:
    e = F.sum(c).cast("bigint")
    return e.alias(alias) if alias else e


def dedup_users(t2: DataFrame) -> DataFrame:
    """One row per (state, year, quarter) of ``aggregated_user``.

    ``registered_users``/``app_opens`` repeat on every brand row; ``max`` picks the
    repeated value deterministically (pandas ``drop_duplicates`` keeps the first).
    Idempotent: applied to an already de-duplicated frame (``DerivedTables.user_totals``)
    it returns the same rows, so operators reading only de-duplicated users take either.
    """
    return (t2.groupBy("state", "year", "quarter")
            .agg(F.max("registered_users").alias("registered_users"),
                 F.max("app_opens").alias("app_opens")))


def state_users(t2: DataFrame, user_grain: str = "deduped", name: str = "total_users") -> DataFrame:
    """Registered users per state.

    ``user_grain="rows"`` sums every row, as the SQL statements do (inflated by the
    number of brand rows); ``"deduped"`` sums one value per state-quarter, as the
    dashboard does.
    """
    if user_grain == "rows":
        src = t2
    elif user_grain == "deduped":
        src = dedup_users(t2)
    else:
        raise ValueError("user_grain must be 'rows' or 'deduped'")
    return src.groupBy("state").agg(sum_count("registered_users", name))
