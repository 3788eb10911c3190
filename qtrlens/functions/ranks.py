"""Ranks and percentiles over frames of any size, without a window in one task.

Rows are dealt by ranges of the ranked value and sorted there; a partition's rows come after
all rows of the partitions before it, so its offset is the sum of their counts. Ties are
counted by value first, so a value that a third of all rows share is one row when it is dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.session import ensure_checkpoint_dir

#: ``monotonically_increasing_id``: the partition is above these bits, the row's place in it below.
_PLACE_BITS = 33


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in order over its partitions, with the partition (__part) and the place in it (__place).

    Checkpointed: the rows and the partitions' counts must be of one and the same dealing."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    return (dealt.withColumn("__part", F.shiftright("__id", _PLACE_BITS))
            .withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("__id"))


def _with_offsets(dealt: DataFrame, weight: Column) -> DataFrame:
    """``dealt`` with __before (weight of all earlier partitions) and __total. The offsets have a row
    per partition: their window and their broadcast are bounded by the number of partitions."""
    parts = dealt.groupBy("__part").agg(F.sum(weight).alias("__w"))
    before = F.sum("__w").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__w").over(Window.partitionBy()).alias("__total"))
    return dealt.join(F.broadcast(parts), "__part")


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)``; give an order without ties for a defined result."""
    dealt = _with_offsets(_dealt(df, list(order)), F.lit(1))
    return dealt.withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before", "__total")


def value_ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """``(value, n, before, total)`` for each distinct non-null value: rows that have it, rows that come
    before them, and all. ``before + 1`` is RANK(), ``before + (n + 1) / 2`` the average rank of ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = _with_offsets(_dealt(counts, [order]), F.col("n"))
    inside = F.sum("n").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.select(value, "n", (F.col("__before") + F.coalesce(inside, F.lit(0))).alias("before"), F.col("__total").alias("total"))


def with_percent_rank(df: DataFrame, value: str, name: str = "pct_rank") -> DataFrame:
    """pandas ``rank(pct=True)`` over the whole frame: average rank of ties by the number of values.
    Rows with a NULL value get NULL. The ranks have a row per distinct value."""
    ranks = value_ranks(df, value)
    pct = (F.col("before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")
    ranks = ranks.select(F.col(value).alias("__v"), pct.alias(name))
    return df.join(ranks, df[value] == F.col("__v"), "left").drop("__v")


def percentiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row with the exact interpolated percentiles ``p0``, ``p1``, ... of the non-null values: for
    each share the values at the two ranks around it are picked out, then interpolated."""
    ranks = value_ranks(df.select(F.col(value).cast("double").alias("v")), "v")
    def at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    picked, out = [], []
    for i, share in enumerate(shares):
        r = (F.col("total") - 1) * F.lit(float(share))
        picked += [at(F.floor(r)).alias(f"lo{i}"), at(F.ceil(r)).alias(f"hi{i}")]
        r = (F.col("total") - 1) * F.lit(float(share))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(F.floor(r) == F.ceil(r), lo).otherwise((F.ceil(r) - r) * lo + (r - F.floor(r)) * hi).alias(f"p{i}"))
    return ranks.agg(F.max("total").alias("total"), *picked).select(*out)
