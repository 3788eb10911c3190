"""Transaction result sets over aggregated_transaction (T1), map_transaction (T4)
and top_transaction (T7).

Plan shape shared by all of them: a partial + final hash aggregate to a small grain
(states x quarters x categories), then windows over that bounded frame. The only
large grains are districts and pincodes; rankings there use ``orderBy().limit()``
(TakeOrderedAndProject: per-task top-k, no global sort) and concentration shares use
aggregate + join rather than a window per state.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.functions.aggs import sum_count, sum_money
from qtrlens.functions.expr import (crore, dbl, diff_from_mean_pct, first_word, floor1,
                                    fmt_crore, fmt_lakh, fmt_million, fmt_rupees, lakh, pct_change, pct_growth,
                                    period, ratio, share_pct, sign_flag, zscore)
from qtrlens.functions.joins import broadcast_if_small
from qtrlens.functions.windows import arg_best, row_number_desc, top_k, whole, with_prev


AMT, CNT = "transaction_amount", "transaction_count"


def _totals(df: DataFrame, keys: list[str], amount: str = "total_amount", count: str = "total_count") -> DataFrame:
    return df.groupBy(*keys).agg(sum_count(CNT, count), sum_money(AMT, amount))


# ---- sql_queries.sql ----------------------------------------------------------------

def state_segments_sql(t1: DataFrame) -> DataFrame:
    """Four spending segments: P66 of both totals for the top class, means for the rest."""
    s = _totals(t1, ["state"])
    a, c = dbl("total_amount"), dbl("total_count")
    p_amt = F.percentile(a, 0.66).over(whole())
    p_cnt = F.percentile(c, 0.66).over(whole())
    m_amt = ratio(F.sum("total_amount").over(whole()), F.count("total_amount").over(whole()))
    m_cnt = ratio(F.sum("total_count").over(whole()), F.count("total_count").over(whole()))
    segment = (F.when((a >= p_amt) & (c >= p_cnt), "High Value & High Volume")
               .when(a >= m_amt, "High Value").when(c >= m_cnt, "High Volume")
               .otherwise("Growth Potential"))
    return (s.select("state", "total_amount", "total_count",
                     F.round(ratio("total_amount", "total_count"), 2).alias("avg_txn_value"),
                     segment.alias("segment"))
            .orderBy(F.col("total_amount").desc(), "state"))


def ticket_anomaly(t1: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Average ticket per state and its z-score among states; |z| > 2 is an anomaly."""
    s = _totals(t1, ["state"]).withColumn("avg_txn", ratio("total_amount", "total_count"))
    z = zscore("avg_txn", F.avg("avg_txn").over(whole()), F.stddev_samp("avg_txn").over(whole()))
    return (s.withColumn("_z", z)
            .select("state", "avg_txn", "total_count", "total_amount",
                    F.round("_z", 2).alias("z_score"),
                    F.when(F.abs("_z") > threshold, "ANOMALY").otherwise("NORMAL").alias("fraud_signal"),
                    "_z")
            .orderBy(F.abs("_z").desc_nulls_last(), "state").drop("_z"))


def geo_state_totals(t4: DataFrame) -> DataFrame:
    return (t4.groupBy("state").agg(sum_money(AMT, "total_amount"), sum_count(CNT, "total_count"))
            .orderBy(F.col("total_amount").desc(), "state"))


def geo_district_top(t4: DataFrame, k: int = 50) -> DataFrame:
    d = t4.groupBy("state", "district").agg(sum_money(AMT, "total_amount"), sum_count(CNT, "total_count"))
    return top_k(d, k, "total_amount", ["state", "district"])


def category_performance(t1: DataFrame) -> DataFrame:
    c = _totals(t1, ["transaction_type"])
    return (c.select("transaction_type", "total_count", "total_amount",
                     F.round(ratio("total_amount", "total_count"), 2).alias("avg_txn_value"),
                     F.round(share_pct("total_count", F.sum("total_count").over(whole())), 2).alias("count_share_pct"),
                     F.round(share_pct("total_amount", F.sum("total_amount").over(whole())), 2).alias("amount_share_pct"))
            .orderBy(F.col("total_amount").desc(), "transaction_type"))


def revenue_per_user(t1: DataFrame, t2: DataFrame, user_grain: str = "rows") -> DataFrame:
    """Amount per registered user of the state, by state x category (LEFT JOIN users)."""
    from qtrlens.functions.aggs import state_users
    users = state_users(t2, user_grain, "total_users")
    st = t1.groupBy("state", "transaction_type").agg(sum_count(CNT, "txn_count"), sum_money(AMT, "txn_amount"))
    return (st.join(broadcast_if_small(users), "state", "left")
            .select("state", "transaction_type", "txn_count", "txn_amount", "total_users",
                    F.round(ratio("txn_amount", "total_users"), 2).alias("revenue_per_user"))
            .orderBy(F.col("revenue_per_user").desc_nulls_last(), "state", "transaction_type"))


def trend_qoq(t1: DataFrame, calendar: bool = False) -> DataFrame:
    q = t1.groupBy("year", "quarter").agg(sum_money(AMT, "total_amount"), sum_count(CNT, "total_count"))
    q = with_prev(q, "total_amount", names={"total_amount": "prev_amount"}, calendar=calendar)
    return (q.select("year", "quarter", "total_amount", "total_count", "prev_amount",
                     F.round(pct_growth("total_amount", "prev_amount"), 2).alias("qoq_growth_pct"))
            .orderBy("year", "quarter"))


def top_states(t7: DataFrame, k: int = 10, with_avg: bool = False) -> DataFrame:
    """States by value in the top tier (district and pincode rows both counted, as in SQL)."""
    s = _totals(t7, ["state"])
    if with_avg:
        s = s.withColumn("avg_txn_value", F.round(ratio("total_amount", "total_count"), 0))
    return top_k(s, k, "total_amount", ["state"])


def state_loader(t7: DataFrame) -> DataFrame:
    """Every state's totals in the top tier, with the pages' labels (lakh, one-digit crore)."""
    s = top_states(t7, None)
    return s.withColumns({"count_label": fmt_lakh("total_count"), "amount_label": fmt_crore("total_amount", 1)})


def top_places(df: DataFrame, level: str, k: int = 10) -> DataFrame:
    """Top ``k`` districts or pincodes by value (rows of the other level excluded)."""
    d = df.where(F.col(level).isNotNull()).groupBy("state", level).agg(
        sum_count(CNT, "total_count"), sum_money(AMT, "total_amount"))
    return top_k(d, k, "total_amount", ["state", level])


def state_vs_national_sql(t1: DataFrame) -> DataFrame:
    s = t1.groupBy("state").agg(sum_money(AMT, "state_amount"), sum_count(CNT, "state_count"))
    nat = ratio(F.sum("state_amount").over(whole()), F.count("state_amount").over(whole()))
    return (s.withColumn("nat_avg_amount", nat)
            .select("state", "state_amount", "state_count", "nat_avg_amount",
                    F.round(diff_from_mean_pct("state_amount", "nat_avg_amount"), 2).alias("vs_national_pct"))
            .orderBy(F.col("vs_national_pct").desc_nulls_last(), "state"))


# ---- bcs_sql_queries.sql, business case 1 and 7 ---------------------------------------

def txn_category_quarter(t1: DataFrame) -> DataFrame:
    q = _totals(t1, ["year", "quarter", "transaction_type"])
    return (q.select("year", "quarter", "transaction_type", "total_count", "total_amount",
                     F.round(ratio("total_amount", "total_count"), 2).alias("avg_txn_value"))
            .orderBy("year", "quarter", F.col("total_amount").desc(), "transaction_type"))


def txn_category_qoq(t1: DataFrame, calendar: bool = False) -> DataFrame:
    """QoQ growth of amount per category; ``calendar=True`` leaves a gap quarter NULL."""
    q = _totals(t1, ["year", "quarter", "transaction_type"])
    q = with_prev(q, ["total_amount", "total_count"], keys="transaction_type",
                  names={"total_amount": "prev_amount", "total_count": "prev_count"}, calendar=calendar)
    return (q.select("year", "quarter", "transaction_type", "total_amount", "total_count", "prev_amount",
                     F.round(pct_growth("total_amount", "prev_amount"), 2).alias("qoq_growth_pct"))
            .orderBy("year", "quarter", "transaction_type"))


def state_benchmark(t1: DataFrame) -> DataFrame:
    s = t1.groupBy("state").agg(sum_money(AMT, "state_amount"), sum_count(CNT, "state_count"))
    nat = ratio(F.sum("state_amount").over(whole()), F.count("state_amount").over(whole()))
    return (s.withColumn("_nat", nat)
            .select("state", "state_amount", "state_count",
                    F.round(ratio("state_amount", "state_count"), 2).alias("avg_txn_value"),
                    F.round(diff_from_mean_pct("state_amount", "_nat"), 2).alias("vs_national_pct"),
                    F.when(dbl("state_amount") > F.col("_nat"), "Above Average")
                    .otherwise("Below Average").alias("performance_flag"))
            .orderBy(F.col("vs_national_pct").desc_nulls_last(), "state"))


def state_declines(t1: DataFrame, min_run: int = 1) -> DataFrame:
    """State-quarters whose amount fell versus the previous quarter.

    ``min_run=1`` is the statement as written (every single decline); ``min_run=k``
    keeps a quarter only when it ends a run of at least ``k`` consecutive declines.
    """
    q = t1.groupBy("state", "year", "quarter").agg(sum_money(AMT, "amount"))
    q = with_prev(q, "amount", keys="state", names={"amount": "prev_amount"})
    q = q.withColumn("_down", F.col("amount") < F.col("prev_amount"))
    if min_run > 1:
        w = Window.partitionBy("state").orderBy("year", "quarter")
        # islands: a new group starts at every quarter that is not a decline
        q = q.withColumn("_grp", F.sum(F.when(F.col("_down"), 0).otherwise(1)).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        q = q.withColumn("_run", F.sum(F.when(F.col("_down"), 1).otherwise(0)).over(
            Window.partitionBy("state", "_grp").orderBy("year", "quarter")
            .rowsBetween(Window.unboundedPreceding, 0)))
        q = q.where(F.col("_down") & (F.col("_run") >= min_run))
    else:
        q = q.where(F.col("_down"))
    return (q.select("state", "year", "quarter", "amount", "prev_amount",
                     F.round(pct_growth("amount", "prev_amount"), 2).alias("qoq_pct"))
            .orderBy("state", "year", "quarter"))


def top_districts(t4: DataFrame, k: int = 10) -> DataFrame:
    d = (t4.where(F.col("district").isNotNull()).groupBy("state", "district")
         .agg(sum_count(CNT, "total_count"), sum_money(AMT, "total_amount")))
    return top_k(d, k, "total_amount", ["state", "district"])


def top_districts_in_state(t4: DataFrame, state: str, k: int = 10) -> DataFrame:
    d = (t4.where((F.col("state") == state) & F.col("district").isNotNull())
         .groupBy("state", "district").agg(sum_count(CNT, "total_count"), sum_money(AMT, "total_amount"))
         .withColumn("avg_txn_value", F.round(ratio("total_amount", "total_count"), 0)))
    return top_k(d, k, "total_amount", ["state", "district"])


def state_quarter_trend(t4: DataFrame, calendar: bool = False) -> DataFrame:
    q = _totals(t4, ["state", "year", "quarter"])
    q = with_prev(q, "total_amount", keys="state", names={"total_amount": "prev_amount"}, calendar=calendar)
    return (q.select("state", "year", "quarter", "total_count", "total_amount", "prev_amount",
                     F.round(pct_growth("total_amount", "prev_amount"), 2).alias("qoq_growth_pct"))
            .orderBy("state", "year", "quarter"))


# Bounds and labels of the concentration bands.
HHI_BANDS = [("0.25", "Highly Concentrated"), ("0.10", "Moderately Concentrated")]
HHI_SALTS = 32


def concentration_index(df: DataFrame, parent: list[str], child: str, value: str = AMT,
                        round_shares: int = 4) -> DataFrame:
    """Herfindahl index of ``child`` shares of ``value`` within each ``parent`` group.

    Shares are rounded to ``round_shares`` digits before squaring, as the statement
    does. Child totals are a partial aggregate; the parent totals roll up from them and
    meet them on (parent, salt), so the children of one parent are spread over ``HHI_SALTS``
    tasks and reach the last step as one partial sum per task.
    """
    child_tot = df.groupBy(*parent, child).agg(sum_money(value, "child_amount"))
    parent_tot = child_tot.groupBy(*parent).agg(sum_money("child_amount", "parent_amount"))
    parent_tot = parent_tot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HHI_SALTS - 1))))
    salted = child_tot.withColumn("_salt", F.pmod(F.hash(child), F.lit(HHI_SALTS)))
    share = F.round(ratio("child_amount", "parent_amount"), round_shares).cast(f"decimal({round_shares + 6},{round_shares})")
    sq = salted.join(parent_tot, [*parent, "_salt"], "inner").select(*parent, (share * share).alias("sq"))
    agg = sq.groupBy(*parent).agg(F.sum("sq").alias("_hhi"))
    band = (F.when(F.col("_hhi") > F.lit(Decimal(HHI_BANDS[0][0])), HHI_BANDS[0][1])
            .when(F.col("_hhi") > F.lit(Decimal(HHI_BANDS[1][0])), HHI_BANDS[1][1])
            .otherwise("Well Distributed"))
    return (agg.select(*parent, F.round("_hhi", 4).cast("double").alias("hhi_concentration_index"),
                       band.alias("distribution_type"))
            .orderBy(F.col("hhi_concentration_index").desc(), *parent))


def district_hhi(t4: DataFrame, by_quarter: bool = False) -> DataFrame:
    parent = ["state", "year", "quarter"] if by_quarter else ["state"]
    return concentration_index(t4, parent, "district")


def pincode_hhi(t7: DataFrame) -> DataFrame:
    """Concentration over pincodes (top tier pincode rows only)."""
    return concentration_index(t7.where(F.col("pincode").isNotNull()), ["state"], "pincode")


def state_quarter_totals(t4: DataFrame) -> DataFrame:
    return (_totals(t4, ["state", "year", "quarter"])
            .select("state", "year", "quarter", "total_count", "total_amount")
            .orderBy(F.col("total_amount").desc(), "state", "year", "quarter"))


# ---- dashboard result sets ------------------------------------------------------------

def kpi_txn(t1: DataFrame) -> DataFrame:
    """Total value and count, top state by value, top category by count: one row.

    One scan: grouping sets (state) and (category) in a single Expand + aggregate,
    then a one-row aggregate picks the leaders (ties -> smallest name).
    """
    g = (t1.groupingSets([["state"], ["transaction_type"]], "state", "transaction_type")
         .agg(sum_money(AMT, "amount"), sum_count(CNT, "cnt"), F.grouping_id().alias("gid")))
    by_state, by_type = F.col("gid") == 1, F.col("gid") == 2
    out = g.agg(
        F.sum(F.when(by_state, F.col("amount"))).cast("decimal(38,2)").alias("total_amount"),
        F.sum(F.when(by_state, F.col("cnt"))).cast("bigint").alias("total_count"),
        arg_best("state", "amount", where=by_state).alias("top_state"),
        arg_best("transaction_type", "cnt", where=by_type).alias("top_category"))
    return out.withColumn("top_category_word", first_word("top_category"))


def txn_category_period(t1: DataFrame) -> DataFrame:
    q = t1.groupBy("year", "quarter", "transaction_type").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    return (q.select("year", "quarter", "transaction_type", "count", "amount",
                     period().alias("period"), crore("amount").alias("amount_cr"))
            .orderBy("year", "quarter", "transaction_type"))


def category_summary(t1: DataFrame) -> DataFrame:
    c = t1.groupBy("transaction_type").agg(sum_count(CNT, "txn_count"), sum_money(AMT, "amount"))
    return (c.select("transaction_type", "txn_count", "amount",
                     ratio("amount", "txn_count").alias("avg_txn"), crore("amount").alias("amount_cr"),
                     fmt_crore("amount").alias("amount_label"),
                     fmt_rupees(ratio("amount", "txn_count")).alias("avg_txn_label"),
                     fmt_million("txn_count").alias("count_label"))
            .orderBy("transaction_type"))


def state_vs_mean(t1: DataFrame) -> DataFrame:
    s = t1.groupBy("state").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    avg_cr = (ratio(F.sum("amount").over(whole()), F.count("amount").over(whole()))) / F.lit(1e7)
    s = s.withColumn("amount_cr", crore("amount")).withColumn("national_avg_cr", avg_cr)
    s = s.withColumn("vs_avg", F.round(diff_from_mean_pct("amount_cr", "national_avg_cr"), 1))
    return (s.select("state", "count", "amount", "amount_cr", "vs_avg", sign_flag("vs_avg").alias("vs_avg_flag"))
            .orderBy(F.col("amount").desc(), "state"))


def kpi_map(t4: DataFrame) -> DataFrame:
    """States covered, total value and count, top district by value (district name
    grouped across states, as the page does)."""
    g = (t4.groupingSets([["state"], ["district"]], "state", "district")
         .agg(sum_money(AMT, "amount"), sum_count(CNT, "cnt"), F.grouping_id().alias("gid")))
    by_state, by_dist = F.col("gid") == 1, F.col("gid") == 2
    return g.agg(
        F.count(F.when(by_state, F.col("state"))).cast("bigint").alias("states"),
        F.sum(F.when(by_state, F.col("amount"))).cast("decimal(38,2)").alias("total_amount"),
        F.sum(F.when(by_state, F.col("cnt"))).cast("bigint").alias("total_count"),
        arg_best("district", "amount", where=by_dist).alias("top_district"))


def state_rank(t4: DataFrame, top_n: int = 10) -> DataFrame:
    s = t4.groupBy("state").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    s = (s.withColumn("amount_cr", crore("amount"))
         .withColumn("avg_txn", dbl("amount") / dbl(floor1("count")))
         .withColumn("rank", row_number_desc("amount", ["state"]).cast("int")))
    return (s.where(F.col("rank") <= top_n)
            .select("rank", "state", "count", "amount", "amount_cr", "avg_txn",
                    fmt_crore("amount").alias("amount_label"), fmt_rupees("avg_txn").alias("avg_txn_label"),
                    fmt_million("count").alias("count_label"))
            .orderBy("rank"))


def district_drill(t4: DataFrame, state: str, top_n: int = 10) -> DataFrame:
    d = (t4.where(F.col("state") == state).groupBy("district")
         .agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
         .where(F.col("district").isNotNull())
         .withColumn("amount_cr", crore("amount")))
    return top_k(d, top_n, "amount", ["district"])


def state_period(t4: DataFrame) -> DataFrame:
    q = t4.groupBy("state", "year", "quarter").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    return (q.select("state", "year", "quarter", "count", "amount", period().alias("period"),
                     crore("amount").alias("amount_cr"))
            .orderBy("state", "year", "quarter"))


def kpi_overview(t1: DataFrame, t2: DataFrame, t3: DataFrame) -> DataFrame:
    """Overview KPIs from three tables in one aggregate over their union (no joins).

    ``device_users`` sums ``user_count`` (what the overview labels registered users).
    """
    nul_m, nul_c = F.lit(None).cast("decimal(20,2)"), F.lit(None).cast("bigint")
    u = (t1.select(F.col(AMT).alias("a"), F.col(CNT).alias("c"), nul_c.alias("u"), nul_m.alias("p"))
         .unionByName(t2.select(nul_m.alias("a"), nul_c.alias("c"), F.col("user_count").alias("u"), nul_m.alias("p")))
         .unionByName(t3.select(nul_m.alias("a"), nul_c.alias("c"), nul_c.alias("u"),
                                F.col("insurance_amount").alias("p"))))
    out = u.agg(sum_money("a", "total_txn_amount"), sum_count("c", "total_txn_count"),
                sum_count("u", "device_users"), sum_money("p", "total_premium"))
    return out.withColumn("avg_ticket", dbl("total_txn_amount") / dbl(floor1("total_txn_count")))


def category_table(t1: DataFrame, top_n: int | None = None) -> DataFrame:
    c = t1.groupBy("transaction_type").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
    c = (c.withColumn("avg_txn", ratio("amount", "count")).withColumn("amount_cr", crore("amount"))
         .withColumn("amount_label", fmt_crore("amount")).withColumn("avg_txn_label", fmt_crore("avg_txn")))
    return top_k(c, top_n, "amount", ["transaction_type"])


def category_totals(t1: DataFrame) -> DataFrame:
    """Count and amount per category (the overview's two category charts)."""
    return (t1.groupBy("transaction_type").agg(sum_count(CNT, "transaction_count"), sum_money(AMT, "transaction_amount"))
            .orderBy("transaction_type"))


def quarterly_totals(t1: DataFrame) -> DataFrame:
    q = t1.groupBy("year", "quarter").agg(sum_money(AMT, "amount"), sum_count(CNT, "count"))
    return (q.select("year", "quarter", "amount", "count", period().alias("period"), crore("amount").alias("amount_cr"))
            .orderBy("year", "quarter"))


def top_states_by_value(t1: DataFrame, top_n: int = 10) -> DataFrame:
    s = (t1.groupBy("state").agg(sum_count(CNT, "count"), sum_money(AMT, "amount"))
         .withColumn("amount_cr", crore("amount")))
    return top_k(s, top_n, "amount", ["state"])


# State names whose boundary-file name differs from the data's name.
# All other states map to themselves (the lookup falls back to the state's own name).
STATE_GEO_NAMES = {
    "Dadra And Nagar Haveli And Daman And Diu": "Dadra and Nagar Haveli and Daman and Diu",
    "Delhi": "NCT of Delhi",
}


def geo_metric(t1: DataFrame, t2: DataFrame | None = None, metric: str = "amount") -> DataFrame:
    """Per-state map value: amount in crore, count in lakh, or de-duplicated users in lakh."""
    if metric == "amount":
        v = t1.groupBy("state").agg(sum_money(AMT, "_v")).select("state", crore("_v").alias("_x"))
    elif metric == "count":
        v = t1.groupBy("state").agg(sum_count(CNT, "_v")).select("state", lakh("_v").alias("_x"))
    elif metric == "users":
        from qtrlens.functions.aggs import dedup_users
        v = (dedup_users(t2).groupBy("state").agg(sum_count("registered_users", "_v"))
             .select("state", lakh("_v").alias("_x")))
    else:
        raise ValueError("metric must be amount, count or users")
    return v.select("state", F.round("_x", 2).alias("value"))


def geo_named(values: DataFrame, spark=None) -> DataFrame:
    """Attach the boundary-file name (dimension lookup with fallback to the key)."""
    spark = spark or values.sparkSession
    dim = spark.createDataFrame(list(STATE_GEO_NAMES.items()), "state string, geo_name string")
    return (values.join(broadcast_if_small(dim), "state", "left")
            .withColumn("state_geo", F.coalesce("geo_name", "state")).drop("geo_name"))


def geo_rankings(values: DataFrame, top_n: int | None = None) -> DataFrame:
    r = values.withColumn("rank", row_number_desc("value", ["state"]).cast("int"))
    if top_n is not None:
        r = r.where(F.col("rank") <= top_n)
    return r.select("rank", "state", "value").orderBy("rank")


def amount_yoy(t1: DataFrame) -> DataFrame:
    y = t1.groupBy("year").agg(sum_money(AMT, "transaction_amount"))
    y = with_prev(y, "transaction_amount", order=["year"], names={"transaction_amount": "_prev"})
    return (y.select("year", "transaction_amount", pct_change("transaction_amount", "_prev").alias("growth_pct"),
                     crore("transaction_amount").alias("amount_cr"))
            .orderBy("year"))
