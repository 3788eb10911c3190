"""User result sets over aggregated_user (T2) and top_user (T8).

T2 repeats ``registered_users``/``app_opens`` on every brand row. SQL statements sum
the rows as they are (``user_grain="rows"``); the dashboard first keeps one row per
state-quarter (``user_grain="deduped"``). Both forms are offered where it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtrlens.functions.aggs import dedup_users, sum_count
from qtrlens.functions.expr import (dbl, floor1, million, ordinal, pct_growth, pct_growth_floor1, period,
                                    ratio, share_pct)
from qtrlens.functions.windows import arg_best, pct_rank_avg, top_k, whole, with_prev



def _users_source(t2: DataFrame, user_grain: str) -> DataFrame:
    if user_grain == "rows":
        return t2
    if user_grain == "deduped":
        return dedup_users(t2)
    raise ValueError("user_grain must be 'rows' or 'deduped'")


# ---- sql_queries.sql ---------------------------------------------------------------------

def engagement_quarterly(t2: DataFrame, user_grain: str = "rows") -> DataFrame:
    q = _users_source(t2, user_grain).groupBy("year", "quarter").agg(
        sum_count("registered_users", "total_registered"), sum_count("app_opens", "total_app_opens"))
    return (q.withColumn("engagement_ratio", F.round(ratio("total_app_opens", "total_registered"), 2))
            .orderBy("year", "quarter"))


def brand_share(t2: DataFrame) -> DataFrame:
    """National brand share among rows with a brand (2A; also the scalar-subquery form)."""
    b = t2.where(F.col("brand").isNotNull()).groupBy("brand").agg(sum_count("user_count", "total_users"))
    return (b.withColumn("market_share_pct", F.round(share_pct("total_users", F.sum("total_users").over(whole())), 2))
            .orderBy(F.col("total_users").desc(), "brand"))


# ---- bcs_sql_queries.sql: business case 2 ---------------------------------------------------

def brand_share_state(t2: DataFrame, keep_null_brand: bool = False) -> DataFrame:
    src = t2 if keep_null_brand else t2.where(F.col("brand").isNotNull())
    b = src.groupBy("state", "brand").agg(sum_count("user_count", "brand_users"))
    w = Window.partitionBy("state")
    return (b.withColumn("state_share_pct", F.round(share_pct("brand_users", F.sum("brand_users").over(w)), 2))
            .orderBy("state", F.col("brand_users").desc(), "brand"))


def engagement_state_quarter(t2: DataFrame, digits: int = 4) -> DataFrame:
    q = dedup_users(t2)
    return (q.withColumn("engagement_ratio", F.round(ratio("app_opens", "registered_users"), digits))
            .select("state", "year", "quarter", "registered_users", "app_opens", "engagement_ratio")
            .orderBy(F.col("engagement_ratio").desc_nulls_last(), "state", "year", "quarter"))


def underused_brands(t2: DataFrame, min_share: float = 15.0, rank_gt: int = 3) -> DataFrame:
    """Brands with a large share of their state yet ranked below the top ``rank_gt``."""
    b = t2.where(F.col("brand").isNotNull()).groupBy("state", "brand").agg(sum_count("user_count", "users"))
    b = b.withColumn("state_share_pct", F.round(share_pct("users", F.sum("users").over(Window.partitionBy("state"))), 2))
    b = b.withColumn("brand_rank", F.rank().over(
        Window.partitionBy("state").orderBy(F.col("state_share_pct").desc_nulls_last())).cast("int"))
    return (b.where((F.col("state_share_pct") >= min_share) & (F.col("brand_rank") > rank_gt))
            .orderBy("state", F.col("state_share_pct").desc(), "brand"))


def user_growth_yoy(t2: DataFrame, calendar: bool = False) -> DataFrame:
    a = t2.groupBy("state", "year").agg(F.max("registered_users").alias("reg_users"))
    a = with_prev(a, "reg_users", keys="state", order=["year"], names={"reg_users": "prev_year_users"},
                  calendar=calendar)
    return (a.withColumn("yoy_growth_pct", F.round(pct_growth("reg_users", "prev_year_users"), 2))
            .orderBy("state", "year"))


def brand_share_of_registered(t2: DataFrame) -> DataFrame:
    """Brand users as a share of the state's registered users (page variant)."""
    b = t2.groupBy("state", "brand").agg(sum_count("user_count", "brand_users"),
                                         F.max("registered_users").alias("total_reg"))
    return (b.withColumn("share_pct", F.round(share_pct("brand_users", "total_reg"), 2))
            .orderBy("state", F.col("brand_users").desc(), "brand"))


def big_brands(t2: DataFrame, min_share: float = 15.0) -> DataFrame:
    """Brand share within state above ``min_share`` (page variant: NULL brand kept)."""
    b = t2.groupBy("state", "brand").agg(sum_count("user_count", "users"))
    b = b.withColumn("state_share", F.round(share_pct("users", F.sum("users").over(Window.partitionBy("state"))), 2))
    return b.where(F.col("state_share") > min_share).orderBy("state", F.col("state_share").desc(), "brand")


# ---- bcs_sql_queries.sql: business case 8 ---------------------------------------------------

def _snapshot(t8: DataFrame, year: int, quarter: int) -> DataFrame:
    return t8.where((F.col("year") == year) & (F.col("quarter") == quarter))


def reg_top(t8: DataFrame, year: int, quarter: int, level: str | None = None, k: int | None = 10,
            keep_null_keys: bool = False) -> DataFrame:
    """Top places by registrations in one quarter: states, or districts / pincodes."""
    s = _snapshot(t8, year, quarter)
    keys = ["state"] if level is None else ["state", level]
    if level is not None and not keep_null_keys:
        s = s.where(F.col(level).isNotNull())
    g = s.groupBy(*keys).agg(sum_count("registered_users", "total_registered"))
    return top_k(g, k, "total_registered", keys)


def _state_quarter_regs(t8: DataFrame) -> DataFrame:
    return t8.groupBy("state", "year", "quarter").agg(sum_count("registered_users", "regs"))


def reg_growth_qoq(t8: DataFrame, k: int | None = 20, calendar: bool = False) -> DataFrame:
    q = with_prev(_state_quarter_regs(t8), "regs", keys="state", names={"regs": "prev_regs"}, calendar=calendar)
    q = q.withColumn("qoq_growth_pct", F.round(pct_growth("regs", "prev_regs"), 2))
    return top_k(q, k, "qoq_growth_pct", ["state", "year", "quarter"])


def reg_hotspots(t8: DataFrame, start: tuple[int, int], end: tuple[int, int], k: int = 10) -> DataFrame:
    """Growth from the first to the last quarter of a period, per state.

    First/last value per state are ``min_by``/``max_by`` on the quarter ordinal: a
    plain aggregate, so no window or DISTINCT over the state's rows is needed.
    """
    from qtrlens.operators.filters import period_range
    q = _state_quarter_regs(period_range(t8, start, end)).withColumn("_ord", ordinal())
    g = q.groupBy("state").agg(F.min_by("regs", "_ord").alias("regs_start"), F.max_by("regs", "_ord").alias("regs_end"))
    g = g.withColumn("growth_over_period_pct", F.round(pct_growth("regs_end", "regs_start"), 2))
    return top_k(g, k, "growth_over_period_pct", ["state"])


def reg_declines(t8: DataFrame) -> DataFrame:
    q = with_prev(_state_quarter_regs(t8), "regs", keys="state", names={"regs": "prev_regs"})
    return (q.where(F.col("regs") < F.col("prev_regs"))
            .withColumn("qoq_growth_pct", F.round(pct_growth("regs", "prev_regs"), 2))
            .orderBy(F.col("qoq_growth_pct").asc_nulls_last(), "state", "year", "quarter"))


# ---- dashboard result sets ------------------------------------------------------------------

def kpi_users(t2: DataFrame) -> DataFrame:
    """De-duplicated registered users and opens, engagement ratio, dominant brand.

    One Expand + aggregate computes both grains (state-quarter and brand); a one-row
    aggregate then combines them.
    """
    g = (t2.groupingSets([["state", "year", "quarter"], ["brand"]], "state", "year", "quarter", "brand")
         .agg(F.max("registered_users").alias("reg"), F.max("app_opens").alias("opens"),
              sum_count("user_count", "users"), F.grouping_id().alias("gid")))
    sq, br = F.col("gid") == 1, F.col("gid") == 14
    out = g.agg(F.sum(F.when(sq, F.col("reg"))).cast("bigint").alias("total_registered"),
                F.sum(F.when(sq, F.col("opens"))).cast("bigint").alias("total_app_opens"),
                arg_best("brand", "users", where=br).alias("top_brand"))
    return out.withColumn("engagement_ratio", F.round(ratio("total_app_opens", "total_registered"), 2))


def brand_share_1dp(t2: DataFrame) -> DataFrame:
    b = t2.where(F.col("brand").isNotNull()).groupBy("brand").agg(sum_count("user_count", "user_count"))
    return (b.withColumn("pct", F.round(share_pct("user_count", F.sum("user_count").over(whole())), 1))
            .orderBy(F.col("user_count").desc(), "brand"))


def top_brand_trend(t2: DataFrame, k: int = 4) -> DataFrame:
    """Brand users per quarter for the ``k`` largest brands (ties -> first by name).

    One pass: the quarter x brand aggregate is small, so the brand totals and the
    top-k rank are windows over it; no second read of the table, no join.
    """
    q = (t2.where(F.col("brand").isNotNull())
         .groupBy("year", "quarter", "brand").agg(sum_count("user_count", "user_count")))
    total = F.sum("user_count").over(Window.partitionBy("brand"))
    q = q.withColumn("_total", total)
    rank = F.dense_rank().over(Window.orderBy(F.col("_total").desc(), F.col("brand").asc()))
    return (q.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_total", "_rank")
            .withColumn("period", period()).orderBy("year", "quarter", "brand"))


def engagement_by_state(t2: DataFrame) -> DataFrame:
    """Per state: Σusers, Σopens and the mean of per-quarter ratios (rounded to 2)."""
    d = dedup_users(t2).withColumn(
        "_r", F.round(dbl("app_opens") / dbl(floor1("registered_users")), 2).cast("decimal(20,2)"))
    s = d.groupBy("state").agg(sum_count("registered_users", "reg"), sum_count("app_opens", "opens"),
                               F.sum("_r").alias("_rs"), F.count("_r").alias("_rn"))
    s = s.withColumn("ratio", F.round(ratio("_rs", "_rn"), 2))
    return (s.select("state", "reg", "opens", "ratio",
                     ratio(F.sum(F.col("ratio").cast("decimal(20,2)")).over(whole()), F.count("ratio").over(whole())).alias("mean_ratio"),
                     ratio(F.sum("opens").over(whole()), F.count("opens").over(whole())).alias("mean_opens"))
            .orderBy(F.col("ratio").desc_nulls_last(), "state"))


def engagement_by_quarter(t2: DataFrame) -> DataFrame:
    q = dedup_users(t2).groupBy("year", "quarter").agg(sum_count("registered_users", "reg"), sum_count("app_opens", "opens"))
    return (q.withColumn("period", period()).withColumn("ratio", F.round(ratio("opens", "reg"), 2))
            .orderBy("year", "quarter"))


def brand_gap(t2: DataFrame, state: str) -> DataFrame:
    """In one state: share vs opens-per-user percentile; positive gap = underused brand."""
    b = (t2.where((F.col("state") == state) & F.col("brand").isNotNull()).groupBy("brand")
         .agg(sum_count("user_count", "users"), sum_count("app_opens", "opens"), sum_count("registered_users", "reg")))
    b = (b.withColumn("share_pct", F.round(share_pct("users", F.sum("users").over(whole())), 1))
         .withColumn("opens_per_user", F.round(dbl("opens") / dbl(floor1("users")), 1)))
    b = b.withColumn("gap", F.col("share_pct") - pct_rank_avg("opens_per_user") * F.lit(100.0))
    # the page's reference lines: mean share and mean opens per user over the brands
    b = (b.withColumn("mean_share_pct", ratio(F.sum(F.col("share_pct").cast("decimal(20,1)")).over(whole()),
                                              F.count("share_pct").over(whole())))
         .withColumn("mean_opens_per_user", ratio(F.sum(F.col("opens_per_user").cast("decimal(20,1)")).over(whole()),
                                                  F.count("opens_per_user").over(whole()))))
    return b.orderBy(F.col("gap").desc_nulls_last(), "brand")


def kpi_registrations(t8: DataFrame, year: int, quarter: int, literal_prev: bool = False) -> DataFrame:
    """Registrations in one quarter, growth on the previous quarter, top state/district.

    ``literal_prev=True`` compares with ``(year, max(quarter-1, 1))`` as the page does
    (Q1 against itself); the default steps back to Q4 of the previous year.
    """
    if literal_prev:
        py, pq = year, max(quarter - 1, 1)
    else:
        py, pq = (year, quarter - 1) if quarter > 1 else (year - 1, 4)
    snap_ord, prev_ord = year * 4 + quarter, py * 4 + pq
    # the year bound is redundant with the ordinal test but reaches the scan (partition
    # pruning on year-partitioned tables); the ordinal handles the quarter edge
    rows = (t8.where(F.col("year").isin(sorted({year, py})) & ordinal().isin(snap_ord, prev_ord))
            .withColumn("_snap", ordinal() == snap_ord).withColumn("_prev", ordinal() == prev_ord))
    g = (rows.groupingSets([["_snap", "_prev", "state"], ["_snap", "_prev", "district"]],
                           "_snap", "_prev", "state", "district")
         .agg(sum_count("registered_users", "regs"), F.grouping_id().alias("gid")))
    st, di = F.col("gid") == 1, F.col("gid") == 2
    out = g.agg(
        F.coalesce(F.sum(F.when(st & F.col("_snap"), F.col("regs"))), F.lit(0)).cast("bigint").alias("registrations"),
        F.coalesce(F.sum(F.when(st & F.col("_prev"), F.col("regs"))), F.lit(0)).cast("bigint").alias("prev_registrations"),
        arg_best("state", "regs", where=st & F.col("_snap")).alias("_ts"),
        arg_best("district", "regs", where=di & F.col("_snap")).alias("_td"))
    growth = (dbl("registrations") - dbl("prev_registrations")) / dbl(F.greatest(F.col("prev_registrations"), F.lit(1))) * 100.0
    return out.select("registrations", "prev_registrations", F.round(growth, 1).alias("growth_pct"),
                      F.coalesce("_ts", F.lit("N/A")).alias("top_state"),
                      F.coalesce("_td", F.lit("N/A")).alias("top_district"))


def reg_trend(t8: DataFrame) -> DataFrame:
    q = t8.groupBy("state", "year", "quarter").agg(sum_count("registered_users", "registered_users"))
    q = with_prev(q, "registered_users", keys="state", names={"registered_users": "prev"})
    return (q.withColumn("growth_pct", F.round(pct_growth_floor1("registered_users", "prev"), 1))
            .withColumn("period", period()).orderBy("state", "year", "quarter"))


def reg_volume(t8: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Registrations per state and quarter (the volume chart); ``states`` optionally
    restricts the series (the page draws its first selected states)."""
    src = t8 if not states else t8.where(F.col("state").isin(states))
    q = src.groupBy("state", "year", "quarter").agg(sum_count("registered_users", "registered_users"))
    return q.withColumn("period", period()).orderBy("state", "year", "quarter")


def reg_avg_growth(t8: DataFrame, year: int, k: int = 10) -> DataFrame:
    """Mean quarterly registration growth per state within ``year`` (top ``k``)."""
    r = reg_trend(t8).where(F.col("year") == year)
    g = r.groupBy("state").agg(ratio(F.sum(F.col("growth_pct").cast("decimal(20,1)")),
                                     F.count("growth_pct")).alias("growth_pct"))
    return top_k(g, k, "growth_pct", ["state"])


def brand_users(t2: DataFrame, top_n: int | None = None) -> DataFrame:
    b = t2.where(F.col("brand").isNotNull()).groupBy("brand").agg(sum_count("user_count", "user_count"))
    return top_k(b, top_n, "user_count", ["brand"])


def users_over_time(t2: DataFrame) -> DataFrame:
    q = dedup_users(t2).groupBy("year", "quarter").agg(sum_count("registered_users", "reg_users"),
                                                       sum_count("app_opens", "app_opens"))
    return (q.withColumn("period", period()).withColumn("reg_users_m", million("reg_users"))
            .withColumn("app_opens_m", million("app_opens")).orderBy("year", "quarter"))


def low_engagement(t2: DataFrame, below: float = 2.0) -> DataFrame:
    """States whose mean engagement ratio is under ``below`` opens per user."""
    return engagement_by_state(t2).where(F.col("ratio") < below).select("state", "reg", "opens", "ratio")
