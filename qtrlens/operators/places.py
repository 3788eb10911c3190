"""The pages' segments, ranks and shares at the grain of single places (pincodes).

A state has tens of rows and a window over all of them is harmless; pincodes are as many as the
data holds. Here thresholds and totals are scalar subqueries, ranks come from range partitions
(``functions.ranks``), and no task sees all places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtrlens.functions.aggs import sum_count, sum_money
from qtrlens.functions.expr import crore, dbl, diff_from_mean_pct, ratio, share_pct, sign_flag
from qtrlens.functions.ranks import global_positions, percentiles, with_percent_rank
from qtrlens.operators.signals import SEGMENT_LABELS
from qtrlens.session import ensure_checkpoint_dir

AMT, CNT = "transaction_amount", "transaction_count"
PLACE = ("state", "pincode")


def place_totals(df: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    return df.groupBy(*keys).agg(sum_money(AMT, "total_amount"), sum_count(CNT, "total_count"))


def place_segments(df: DataFrame, keys: Sequence[str] = PLACE, q: float = 0.66) -> DataFrame:
    """The segmentation of the page at any grain: exact percentiles of total amount and total count
    over all groups decide the four classes."""
    ensure_checkpoint_dir(df.sparkSession)
    s = place_totals(df, keys).checkpoint()  # read by both percentiles and the classes
    a, c = dbl("total_amount"), dbl("total_count")
    qa, qc = (percentiles(s, x, [q]).scalar() for x in ("total_amount", "total_count"))
    seg = (F.when((a >= F.col("__qa")) & (c >= F.col("__qc")), SEGMENT_LABELS[0]).when(a >= F.col("__qa"), SEGMENT_LABELS[1])
           .when(c >= F.col("__qc"), SEGMENT_LABELS[2]).otherwise(SEGMENT_LABELS[3]))
    return s.withColumn("__qa", qa).withColumn("__qc", qc).select(*keys, "total_amount", "total_count", seg.alias("segment"))


def place_ranking(df: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """All places from the largest total on, with their position; ties go by key."""
    s = place_totals(df, keys)
    order = [F.col("total_amount").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    return global_positions(s, order).select("rank", *keys, F.round(crore("total_amount"), 2).alias("value"))


def place_percent_ranks(df: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """Percentile rank of each place's number of transactions, ties at their average rank."""
    s = place_totals(df, keys).select(*keys, F.col("total_count").alias("txn_count"))
    ranked = with_percent_rank(s, "txn_count")
    return ranked.select(*keys, "txn_count", F.round("pct_rank", 6).alias("pct_rank"))


def place_shares(df: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """Share of the grand total, size against the largest place, and distance from the mean place."""
    s = place_totals(df, keys).select(*keys, "total_amount")
    total, largest, n = (s.agg(x).scalar() for x in (F.sum("total_amount"), F.max("total_amount"), F.count("total_amount")))
    s = s.withColumn("__total", total).withColumn("__max", largest).withColumn("__mean", ratio(total, n))
    away = diff_from_mean_pct("total_amount", "__mean")
    return s.select(*keys, "total_amount", F.round(share_pct("total_amount", "__total"), 6).alias("share_pct"),
                    F.round(ratio("total_amount", "__max"), 6).alias("of_largest"), F.round(away, 2).alias("diff_from_mean_pct"),
                    sign_flag(F.round(away, 2)).alias("flag"))
