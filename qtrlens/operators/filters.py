"""Selection filters of the dashboard and the statements.

All are ``where`` predicates on plain columns (pushed into Parquet scans and, on
tables partitioned by ``year``, pruning partitions) or semi joins on small key sets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtrlens.functions.expr import ordinal


def select_years_states(df: DataFrame, years: Iterable[int] | None = None,
                        states: Iterable[str] | None = None) -> DataFrame:
    """``year IN (...) AND state IN (...)``; an empty or missing selection means all."""
    out = df
    ys, ss = list(years or []), list(states or [])
    if ys:
        out = out.where(F.col("year").isin(ys))
    if ss:
        out = out.where(F.col("state").isin(ss))
    return out


def newest_years(df: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` newest years present in ``df``, as a one-column DataFrame (at most n rows)."""
    return df.select("year").distinct().orderBy(F.col("year").desc()).limit(n)


def select_newest_years(df: DataFrame, n: int = 2, years_from: DataFrame | None = None) -> DataFrame:
    """Rows of the ``n`` newest years (of ``years_from``, default ``df``): the dashboard's
    default year selection as a semi join, computed on the cluster (no driver collect).
    The key set has at most ``n`` rows, so broadcasting it is bounded by construction. Give
    ``years_from`` the narrowest frame that has the years (a date column, a partition
    column): it is read for them alone. The semi join on a grouping key goes below the
    aggregates of ``df``, so older years are dropped before they are summed.
    """
    keys = newest_years(years_from if years_from is not None else df, n)
    return df.join(F.broadcast(keys), "year", "left_semi")


def period_range(df: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Quarters from ``start`` to ``end`` inclusive, e.g. (2023, 3) .. (2024, 4).

    Written as a year range plus an ordinal test so the year bound still reaches the
    scan (and prunes ``year`` partitions) while the ordinal handles quarter edges.
    """
    lo, hi = start[0] * 4 + start[1], end[0] * 4 + end[1]
    return df.where(F.col("year").between(start[0], end[0]) & ordinal().between(lo, hi))
