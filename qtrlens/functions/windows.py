"""Window and ranking helpers.

Every window here runs on an already aggregated frame whose partitions are bounded
by the calendar (quarters per state) or by a small dimension (brands, categories).
Shares over unbounded children (pincodes within a state) are not windows: see
``operators.txn.concentration_index`` (child totals rolled up and joined back).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.functions.expr import ordinal


def whole() -> Window:
    """Window over the whole frame; only for aggregated frames of bounded size."""
    return Window.partitionBy()


def _keys(keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def with_prev(df: DataFrame, cols: Sequence[str] | str, keys: Sequence[str] | str | None = None,
              order: Sequence[str] = ("year", "quarter"), prefix: str = "prev_",
              calendar: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Add the previous row's value of each column (``LAG``) per ``keys`` in ``order``.

    ``calendar=False`` is positional LAG, as in SQL: a missing quarter makes the step
    span two quarters. ``calendar=True`` keeps the previous value only when it belongs
    to the immediately preceding period (quarter ordinal, or year when ordering by year).
    """
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    names = names or {}
    out = df
    if calendar:
        if list(order) == ["year", "quarter"]:
            step = ordinal("year", "quarter")
        elif list(order) == ["year"]:
            step = F.col("year").cast("int")
        else:
            raise ValueError("calendar lag needs order (year, quarter) or (year)")
        out = out.withColumn("__ord", step).withColumn("__prev_ord", F.lag("__ord").over(w))
    for c in _keys(cols):
        lagged = F.lag(c).over(w)
        if calendar:
            lagged = F.when(F.col("__ord") - F.col("__prev_ord") == 1, lagged)
        out = out.withColumn(names.get(c, prefix + c), lagged)
    if calendar:
        out = out.drop("__ord", "__prev_ord")
    return out


def pct_rank_avg(value: str, keys: Sequence[str] | str | None = None) -> Column:
    """pandas ``rank(pct=True)``: average rank of ties divided by the group size.

    1, 2, 2, 4 -> .25, .625, .625, 1. NULL values get NULL.
    """
    part = _keys(keys)
    rank = F.rank().over(Window.partitionBy(*part).orderBy(F.col(value).asc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, value))
    n = F.count(value).over(Window.partitionBy(*part))
    avg_rank = rank.cast("double") + (ties.cast("double") - F.lit(1.0)) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), avg_rank / n.cast("double"))


def row_number_desc(value: str, tie: Sequence[str], keys: Sequence[str] | str | None = None) -> Column:
    """1-based position after sorting by ``value`` descending, then ``tie`` ascending."""
    order = [F.col(value).desc_nulls_last()] + [F.col(t).asc_nulls_last() for t in tie]
    return F.row_number().over(Window.partitionBy(*_keys(keys)).orderBy(*order))


def top_k(df: DataFrame, k: int | None, value: str, tie: Sequence[str], ascending: bool = False) -> DataFrame:
    """Sort by ``value`` (NULLs last) with a full tie-break, then keep ``k`` rows.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its own top k
    and only those reach the final merge.
    """
    v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    out = df.orderBy(v, *[F.col(t).asc_nulls_last() for t in tie])
    return out if k is None else out.limit(k)


def arg_best(key: str, value: str, largest: bool = True, where: Column | None = None) -> Column:
    """Aggregate: the ``key`` with the largest (or smallest) ``value``; ties -> smallest key.

    Rows with a NULL key or value (or failing ``where``) are ignored, like pandas
    ``groupby().idxmax()``. Built on ``min_by`` over a struct, so it is an ordinary
    partial/final aggregate (no sort, no window).
    """
    v = F.col(value)
    ordering = F.struct((-v) if largest else v, F.col(key))
    keep = v.isNotNull() & F.col(key).isNotNull()
    if where is not None:
        keep = keep & where
    return F.min_by(F.col(key), F.when(keep, ordering))
