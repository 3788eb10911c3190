"""Insurance result sets over aggregated_insurance (T3), joined with users (T2).

Joins are LEFT joins of two aggregated frames on ``state``: both sides are per-state
(tens of rows), so the user side is broadcast behind the size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtrlens.functions.aggs import dedup_users, state_users, sum_count, sum_money
from qtrlens.functions.expr import (band_at_least, band_right_closed, crore, dbl, floor1, pct_change, pct_growth,
                                    period, ratio, share_pct, thousand)
from qtrlens.functions.joins import broadcast_if_small
from qtrlens.functions.windows import arg_best, top_k, whole, with_prev

ICNT, IAMT = "insurance_count", "insurance_amount"


def _state_policies(t3: DataFrame) -> DataFrame:
    return t3.groupBy("state").agg(sum_count(ICNT, "total_policies"), sum_money(IAMT, "total_premium"))


# ---- sql_queries.sql ---------------------------------------------------------------------

def insurance_penetration_sql(t3: DataFrame, t2: DataFrame, user_grain: str = "rows") -> DataFrame:
    users = state_users(t2, user_grain, "total_users")
    return (_state_policies(t3).join(broadcast_if_small(users), "state", "left")
            .select("state", "total_policies", "total_premium",
                    F.round(ratio("total_premium", "total_policies"), 2).alias("avg_premium"),
                    F.round(share_pct("total_policies", "total_users"), 4).alias("penetration_rate"))
            .orderBy(F.col("total_premium").desc(), "state"))


def insurance_quarterly(t3: DataFrame) -> DataFrame:
    q = t3.groupBy("year", "quarter").agg(sum_count(ICNT, "total_policies"), sum_money(IAMT, "total_premium"))
    return (q.withColumn("avg_premium", F.round(ratio("total_premium", "total_policies"), 2))
            .orderBy("year", "quarter"))


# ---- bcs_sql_queries.sql: business case 3 ----------------------------------------------

def _penetration(t3: DataFrame, t2: DataFrame, user_grain: str) -> DataFrame:
    users = state_users(t2, user_grain, "total_users")
    return (_state_policies(t3).join(broadcast_if_small(users), "state", "left")
            .withColumn("penetration_pct", F.round(share_pct("total_policies", "total_users"), 4)))


def insurance_penetration(t3: DataFrame, t2: DataFrame, user_grain: str = "rows") -> DataFrame:
    """3A: lowest penetration first (growth targets)."""
    p = _penetration(t3, t2, user_grain)
    return (p.select("state", "total_policies", "total_premium",
                     F.round(ratio("total_premium", "total_policies"), 0).alias("avg_premium_per_policy"),
                     F.col("total_users").alias("total_reg_users"), "penetration_pct")
            .orderBy(F.col("penetration_pct").asc_nulls_last(), "state"))


def insurance_growth_yoy(t3: DataFrame) -> DataFrame:
    y = t3.groupBy("year").agg(sum_count(ICNT, "policies"), sum_money(IAMT, "premium"))
    y = with_prev(y, ["policies", "premium"], order=["year"], names={"policies": "prev_policies", "premium": "_pp"})
    return (y.select("year", "policies", "premium", "prev_policies",
                     F.round(pct_growth("policies", "prev_policies"), 2).alias("yoy_policy_growth"),
                     F.round(pct_growth("premium", "_pp"), 2).alias("yoy_premium_growth"))
            .orderBy("year"))


# The score bars and classes of the statement.
SQL_PRIORITY = [(0.3, "Critical Priority"), (0.1, "High Priority"), (0.0, "Medium Priority")]


def insurance_opportunity(t3: DataFrame, t2: DataFrame, user_grain: str = "rows") -> DataFrame:
    """3C: user base relative to the largest minus penetration relative to the highest."""
    p = _penetration(t3, t2, user_grain)
    score = F.round(ratio("total_users", F.max("total_users").over(whole()))
                    - ratio("penetration_pct", F.max("penetration_pct").over(whole())), 3)
    p = p.select("state", F.col("total_policies").alias("policies"), "total_users", "penetration_pct",
                 score.alias("opportunity_score"))
    return (p.withColumn("campaign_priority", band_at_least("opportunity_score", SQL_PRIORITY, "Low Priority"))
            .orderBy(F.col("opportunity_score").desc_nulls_last(), "state"))


def insurance_qoq(t3: DataFrame, calendar: bool = False) -> DataFrame:
    q = t3.groupBy("year", "quarter").agg(sum_count(ICNT, "policies"), sum_money(IAMT, "premium"))
    q = with_prev(q, "policies", names={"policies": "prev_policies"}, calendar=calendar)
    return (q.withColumn("qoq_growth_pct", F.round(pct_growth("policies", "prev_policies"), 2))
            .orderBy("year", "quarter"))


# ---- dashboard result sets ---------------------------------------------------------------

def kpi_insurance(t3: DataFrame) -> DataFrame:
    """Totals, average premium, state with the fewest policies (ties -> first by name)."""
    s = t3.groupBy("state").agg(sum_count(ICNT, "p"), sum_money(IAMT, "a"))
    out = s.agg(sum_count("p", "total_policies"), sum_money("a", "total_premium"),
                arg_best("state", "p", largest=False).alias("lowest_state"))
    return (out.withColumn("avg_premium", dbl("total_premium") / dbl(F.greatest(F.col("total_policies"), F.lit(1))))
            .withColumn("policies_k", thousand("total_policies"))
            .withColumn("premium_cr", crore("total_premium")))


def penetration_dedup(t3: DataFrame, t2: DataFrame) -> DataFrame:
    """Policies per de-duplicated registered user (3 dp), lowest first, with the mean."""
    ins = t3.groupBy("state").agg(sum_count(ICNT, "count"), sum_money(IAMT, "amount"))
    reg = dedup_users(t2).groupBy("state").agg(sum_count("registered_users", "registered_users"))
    p = (ins.join(broadcast_if_small(reg), "state", "left")
         .withColumn("penetration_pct", F.round(dbl("count") / dbl(floor1("registered_users")) * F.lit(100.0), 3))
         .withColumn("avg_premium", dbl("amount") / dbl(floor1("count"))))
    mean = ratio(F.sum(F.col("penetration_pct").cast("decimal(20,3)")).over(whole()), F.count("penetration_pct").over(whole()))
    return p.withColumn("mean_penetration_pct", mean).orderBy(F.col("penetration_pct").asc_nulls_last(), "state")


def insurance_period(t3: DataFrame) -> DataFrame:
    q = t3.groupBy("year", "quarter").agg(sum_count(ICNT, "count"), sum_money(IAMT, "amount"))
    return (q.withColumn("period", period()).withColumn("amount_cr", crore("amount"))
            .orderBy("year", "quarter"))


def insurance_yoy(t3: DataFrame) -> DataFrame:
    y = t3.groupBy("year").agg(sum_count(ICNT, "count"))
    y = with_prev(y, "count", order=["year"], names={"count": "_prev"})
    return (y.withColumn("yoy_growth", pct_change("count", "_prev")).drop("_prev")
            .where(F.col("yoy_growth").isNotNull()).orderBy("year"))


# The bands of the page and their names.
PAGE_EDGES = [-2.0, -0.1, 0.1, 0.3, 1.0]
PAGE_LABELS = ["Low", "Medium", "High", "Critical"]


def opportunity_cut(t3: DataFrame, t2: DataFrame) -> DataFrame:
    """Page form of the opportunity score: right-closed bands, NULL stays unclassified."""
    p = penetration_dedup(t3, t2)
    score = F.round(ratio("registered_users", F.max("registered_users").over(whole()))
                    - ratio("penetration_pct", F.max("penetration_pct").over(whole())), 3)
    p = p.withColumn("opportunity_score", score)
    return (p.select("state", "registered_users", "penetration_pct", "opportunity_score",
                     band_right_closed("opportunity_score", PAGE_EDGES, PAGE_LABELS).alias("priority"))
            .orderBy(F.col("opportunity_score").desc_nulls_last(), "state"))


def opportunity_rollup(t3: DataFrame, t2: DataFrame) -> DataFrame:
    """Priority -> state hierarchy: users per node (ROLLUP), user-weighted mean score."""
    o = opportunity_cut(t3, t2).where(F.col("priority").isNotNull())
    r = (o.rollup("priority", "state")
         .agg(sum_count("registered_users", "users"),
              F.sum(dbl("opportunity_score") * dbl("registered_users")).alias("_w"),
              F.grouping_id().cast("int").alias("level")))
    return (r.withColumn("score", F.round(ratio("_w", "users"), 3)).drop("_w")
            .orderBy("level", "priority", "state"))


def opportunity_top(t3: DataFrame, t2: DataFrame, k: int = 5) -> DataFrame:
    return top_k(opportunity_cut(t3, t2), k, "opportunity_score", ["state"])


def insurance_by_state(t3: DataFrame) -> DataFrame:
    s = t3.groupBy("state").agg(sum_count(ICNT, "count"), sum_money(IAMT, "amount"))
    return s.withColumn("amount_cr", crore("amount")).orderBy(F.col("amount").desc(), "state")


def national_penetration(t3: DataFrame, t2: DataFrame) -> DataFrame:
    """All policies over all (de-duplicated) registered users, in percent: one row."""
    nul = F.lit(None).cast("bigint")
    u = (t3.select(F.col(ICNT).alias("p"), nul.alias("u"))
         .unionByName(dedup_users(t2).select(nul.alias("p"), F.col("registered_users").alias("u"))))
    out = u.agg(sum_count("p", "policies"), sum_count("u", "registered_users"))
    return out.withColumn("penetration_pct", F.round(share_pct("policies", "registered_users"), 4))
