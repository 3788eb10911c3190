"""Segments, anomaly signals and computed findings.

All of these run on per-state (or per state-quarter) aggregates, so their windows
cover tens to hundreds of rows whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.functions.aggs import dedup_users, sum_count, sum_money
from qtrlens.functions.expr import crore, dbl, lakh, pct_growth, ratio, share_pct, zscore
from qtrlens.functions.windows import top_k, whole, with_prev

AMT, CNT = "transaction_amount", "transaction_count"

# Segment labels of the segmentation page and its recommendation per
# segment, in the page's order.
SEGMENT_LABELS = ["🥇 High Value & High Volume", "💎 High Value", "📦 High Volume", "🌱 Growth Potential"]
SEGMENT_RECOMMENDATIONS = {
    "🥇 High Value & High Volume": "Retain with loyalty programs, premium features & exclusive offers.",
    "💎 High Value": "Increase frequency with cashback incentives & payment reminders.",
    "📦 High Volume": "Upsell financial services; promote high-value transaction categories.",
    "🌱 Growth Potential": "Drive awareness campaigns; offer referral bonuses to grow base.",
}


def state_segments_quantile(t1: DataFrame, q: float = 0.66) -> DataFrame:
    """Page segmentation: P66 of total amount and of total count decide all four classes."""
    s = t1.groupBy("state").agg(sum_money(AMT, "total_amount"), sum_count(CNT, "total_count"),
                                ratio(F.sum(AMT), F.count(AMT)).alias("mean_row_amount"))
    a, c = dbl("total_amount"), dbl("total_count")
    qa, qc = F.percentile(a, q).over(whole()), F.percentile(c, q).over(whole())
    seg = (F.when((a >= qa) & (c >= qc), SEGMENT_LABELS[0]).when(a >= qa, SEGMENT_LABELS[1])
           .when(c >= qc, SEGMENT_LABELS[2]).otherwise(SEGMENT_LABELS[3]))
    return (s.select("state", "total_amount", "total_count", "mean_row_amount",
                     crore("total_amount").alias("amount_cr"), lakh("total_count").alias("count_l"),
                     seg.alias("segment"))
            .orderBy(F.col("total_amount").desc(), "state"))


def segment_counts(t1: DataFrame, q: float = 0.66) -> DataFrame:
    """States per segment (largest first) with the recommendation for the segment."""
    spark = t1.sparkSession
    recs = spark.createDataFrame(list(SEGMENT_RECOMMENDATIONS.items()), "segment string, recommendation string")
    counts = state_segments_quantile(t1, q).groupBy("segment").agg(F.count(F.lit(1)).cast("bigint").alias("states"))
    # four fixed rows: the broadcast size is bounded by construction
    return (counts.join(F.broadcast(recs), "segment", "left")
            .orderBy(F.col("states").desc(), "segment"))


def anomaly_flags(t1: DataFrame, grain: str = "state", threshold: float = 2.0) -> DataFrame:
    """Average ticket per state (or state-quarter), z-score among them, |z| > 2 flag."""
    keys = ["state"] if grain == "state" else ["state", "year", "quarter"]
    s = t1.groupBy(*keys).agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    s = s.withColumn("avg_txn", ratio("amount", "count"))
    s = s.withColumn("_z", zscore("avg_txn", F.avg("avg_txn").over(whole()), F.stddev_samp("avg_txn").over(whole())))
    return (s.withColumn("z_score", F.round("_z", 2))
            .withColumn("is_anomaly", F.coalesce(F.abs("_z") > threshold, F.lit(False)))
            .drop("_z").orderBy(*keys))


def ticket_histogram(t1: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of state average tickets, split by the anomaly flag."""
    a = anomaly_flags(t1)
    lo, hi = F.min("avg_txn").over(whole()), F.max("avg_txn").over(whole())
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("avg_txn") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    h = (a.where(F.col("avg_txn").isNotNull())
         .withColumn("bin", b.cast("int")).withColumn("_lo", lo).withColumn("_w", width))
    return (h.groupBy("bin", "is_anomaly", "_lo", "_w")
            .agg(F.count(F.lit(1)).cast("bigint").alias("states"))
            .select("bin", "is_anomaly", "states", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"))
            .orderBy("bin", "is_anomaly"))


def flagged_states(t1: DataFrame, grain: str = "state") -> DataFrame:
    a = anomaly_flags(t1, grain).where(F.col("is_anomaly"))
    keys = ["state"] if grain == "state" else ["state", "year", "quarter"]
    return (a.select(*keys, "avg_txn", "z_score", F.col("count").alias("txn_count"), F.col("amount").alias("total_amount"))
            .orderBy(F.col("z_score").desc(), *keys))


# ---- findings computed instead of fixed text --------------------------------------------

def topk_share(df: DataFrame, key: str = "state", value: str = AMT, k: int = 3) -> DataFrame:
    """The ``k`` largest ``key`` groups, their share and the cumulative share.

    Windows see at most k rows, the groups found by a distributed top-k; the total is a scalar
    subquery over the same aggregate, whose exchange both use.
    """
    s = df.groupBy(key).agg(sum_money(value, "amount") if "amount" in value else sum_count(value, "amount"))
    few = top_k(s, k, "amount", [key]).withColumn("_total", s.agg(F.sum("amount").alias("amount")).scalar())
    order = Window.orderBy(F.col("amount").desc_nulls_last(), F.col(key).asc_nulls_last())
    cum = F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return few.select(key, F.row_number().over(order).cast("int").alias("rank"), "amount",
                      F.round(share_pct("amount", "_total"), 2).alias("share_pct"),
                      F.round(share_pct(cum, "_total"), 2).alias("cum_share_pct")).orderBy("rank")


def seasonality(t1: DataFrame) -> DataFrame:
    """Mean share of the year's amount falling in each quarter of the year."""
    q = t1.groupBy("year", "quarter").agg(sum_money(AMT, "amount"))
    q = q.withColumn("_share", F.round(share_pct("amount", F.sum("amount").over(Window.partitionBy("year"))), 4)
                     .cast("decimal(10,4)"))
    return (q.groupBy("quarter").agg(F.round(ratio(F.sum("_share"), F.count("_share")), 2).alias("mean_share_pct"),
                                     F.count(F.lit(1)).cast("bigint").alias("years"))
            .orderBy("quarter"))


def fastest_category(t1: DataFrame, k: int = 1) -> DataFrame:
    """Category with the highest mean quarter-on-quarter growth."""
    from qtrlens.operators.txn import txn_category_qoq
    g = txn_category_qoq(t1).groupBy("transaction_type").agg(
        F.round(ratio(F.sum(F.col("qoq_growth_pct").cast("decimal(20,2)")), F.count("qoq_growth_pct")), 2)
        .alias("mean_qoq_pct"))
    return top_k(g, k, "mean_qoq_pct", ["transaction_type"])


def ticket_leader(t1: DataFrame, k: int = 1) -> DataFrame:
    """Category with the highest average ticket (amount / count)."""
    g = (t1.groupBy("transaction_type").agg(sum_money(AMT, "amount"), sum_count(CNT, "count"))
         .withColumn("avg_ticket", F.round(ratio("amount", "count"), 2)))
    return top_k(g, k, "avg_ticket", ["transaction_type"])


def kpi_delta(t1: DataFrame, t2: DataFrame, t3: DataFrame) -> DataFrame:
    """Per year: value, count, de-duplicated users, policies, each with YoY % (1 dp).

    One aggregate over the union of the three yearly inputs, then a LAG over years.
    """
    m, n = F.lit(None).cast("decimal(20,2)"), F.lit(None).cast("bigint")
    u = (t1.select("year", F.col(AMT).alias("a"), F.col(CNT).alias("c"), n.alias("u"), n.alias("p"))
         .unionByName(dedup_users(t2).select("year", m.alias("a"), n.alias("c"),
                                             F.col("registered_users").alias("u"), n.alias("p")))
         .unionByName(t3.select("year", m.alias("a"), n.alias("c"), n.alias("u"), F.col("insurance_count").alias("p"))))
    y = u.groupBy("year").agg(sum_money("a", "amount"), sum_count("c", "count"),
                              sum_count("u", "registered_users"), sum_count("p", "policies"))
    cols = ["amount", "count", "registered_users", "policies"]
    y = with_prev(y, cols, order=["year"], prefix="_p_")
    out = y.select("year", *cols, *[F.round(pct_growth(c, "_p_" + c), 1).alias(f"{c}_yoy_pct") for c in cols])
    return out.orderBy("year")
