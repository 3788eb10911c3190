"""Synthetic tables for the demo mode (no database): same schemas, value ranges and
row counts as the source's generators, generated in Spark.

Rows come from exploding the dimension lists (a generator, no joins) and every value
is a deterministic function of its key and a seed via ``xxhash64``, so generation is
parallel, reproducible and independent of partitioning (not the numpy sequence of the
source, whose values depend on call order). These frames feed the same operators as
the real tables; they are not registered as queries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The demo dimensions and weights of the source's generators, in the
# source's order.
DEMO_STATES = ["Maharashtra", "Karnataka", "Tamil Nadu", "Uttar Pradesh", "Gujarat",
               "Andhra Pradesh", "Rajasthan", "West Bengal", "Telangana", "Madhya Pradesh"]
DEMO_CATEGORIES = ["Peer-to-Peer", "Recharge & Bill Payments", "Merchant Payments", "Financial Services", "Others"]
DEMO_BRANDS = ["Samsung", "Xiaomi", "Vivo", "OPPO", "OnePlus", "Apple", "Realme", "Others"]
YEARS = [2020, 2021, 2022, 2023, 2024]
QUARTERS = [1, 2, 3, 4]

CASE_STATES = DEMO_STATES + ["Odisha", "Punjab", "Haryana", "Kerala", "Bihar"]
CASE_DISTRICTS = ["Mumbai", "Bangalore", "Chennai", "Lucknow", "Ahmedabad", "Hyderabad", "Jaipur", "Kolkata",
                  "Pune", "Surat", "Bhopal", "Patna", "Chandigarh", "Kochi", "Indore"]
CASE_CATEGORIES = ["Peer-to-Peer", "Merchant Payments", "Financial Services", "Recharge & Bill Payments", "Others"]
CASE_BRANDS = ["Samsung", "Xiaomi", "Vivo", "OPPO", "OnePlus", "Realme", "Apple", "Others"]
CATEGORY_WEIGHT = {"Peer-to-Peer": 1.4, "Merchant Payments": 1.1, "Financial Services": 0.85,
                   "Recharge & Bill Payments": 0.55, "Others": 0.3}
BRAND_WEIGHT = {"Samsung": 0.28, "Xiaomi": 0.24, "Vivo": 0.14, "OPPO": 0.11, "OnePlus": 0.08, "Realme": 0.07,
                "Apple": 0.04, "Others": 0.04}

# Ranges, yearly growth and noise of the generators.
DEMO_RANGES = {"transaction_count": (1_000, 50_000), "transaction_amount": (5_000_000, 500_000_000), "user_count": (1_000, 200_000),
               "registered_users": (100_000, 5_000_000), "app_opens": (500_000, 20_000_000),
               "insurance_count": (500, 20_000), "insurance_amount": (1_000_000, 100_000_000)}
FIRST_YEAR = 2020
TXN_BASE_MILLIONS, TXN_COUNT, TXN_GROWTH, TXN_NOISE = (8, 40), (5_000, 50_000), 0.18, (0.85, 0.30)
USER_BASE, USER_GROWTH, USER_NOISE, OPENS_PER_USER, BRAND_NOISE = (200_000, 5_000_000), 0.20, (0.9, 0.2), (2.0, 4.0), (0.85, 0.3)
POLICY_BASE, POLICY_GROWTH, POLICY_NOISE, PREMIUM = (2_000, 30_000), 0.25, (0.85, 0.3), (8_000, 45_000)
MAP_BASE, MAP_NOISE = (5_000_000, 80_000_000), (0.8, 0.4)
HOME_COUNT, AWAY_COUNT, AWAY_AMOUNT = (10_000, 300_000), (2_000, 80_000), (1_000_000, 30_000_000)
REGISTRATIONS, PINCODE_RANGE, PINCODES = (5_000, 500_000), (100_000, 999_999), 30


def _grid(spark: SparkSession, **dims: Sequence) -> DataFrame:
    """All combinations of the given dimension lists, by successive explodes."""
    df = spark.range(1).select()
    for name, values in dims.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def _u(seed: int, salt: str, *keys: str) -> Column:
    """Deterministic uniform [0, 1) from the key columns."""
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.lit(salt))
    return F.pmod(h, F.lit(1_000_000_007)).cast("double") / F.lit(1_000_000_007.0)


def _int_between(lo: int, hi: int, u: Column) -> Column:
    """Integer in [lo, hi) from a uniform column."""
    return (F.lit(lo) + F.floor(u * F.lit(hi - lo))).cast("bigint")


def _weight(col: str, weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col(col))


def _typed(df: DataFrame) -> DataFrame:
    casts = {"year": "smallint", "quarter": "int", "transaction_amount": "decimal(20,2)",
             "insurance_amount": "decimal(20,2)"}
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


# ---- demo tables of the general pages (S18-S20) ---------------------------------------

def demo_transactions(spark: SparkSession, seed: int = 42) -> DataFrame:
    g = _grid(spark, state=DEMO_STATES, year=YEARS, quarter=QUARTERS, transaction_type=DEMO_CATEGORIES)
    k = ["state", "year", "quarter", "transaction_type"]
    return _typed(g.select(*k, _int_between(*DEMO_RANGES["transaction_count"], _u(seed, "c", *k)).alias("transaction_count"),
                           _int_between(*DEMO_RANGES["transaction_amount"], _u(seed, "a", *k)).alias("transaction_amount")))


def demo_users(spark: SparkSession, seed: int = 7) -> DataFrame:
    g = _grid(spark, state=DEMO_STATES, year=YEARS, quarter=QUARTERS, brand=DEMO_BRANDS)
    sq = ["state", "year", "quarter"]
    return _typed(g.select(*sq, "brand",
                           _int_between(*DEMO_RANGES["user_count"], _u(seed, "u", *sq, "brand")).alias("user_count"),
                           _int_between(*DEMO_RANGES["registered_users"], _u(seed, "r", *sq)).alias("registered_users"),
                           _int_between(*DEMO_RANGES["app_opens"], _u(seed, "o", *sq)).alias("app_opens")))


def demo_insurance(spark: SparkSession, seed: int = 99) -> DataFrame:
    g = _grid(spark, state=DEMO_STATES, year=YEARS, quarter=QUARTERS)
    k = ["state", "year", "quarter"]
    return _typed(g.select(*k, _int_between(*DEMO_RANGES["insurance_count"], _u(seed, "c", *k)).alias("insurance_count"),
                           _int_between(*DEMO_RANGES["insurance_amount"], _u(seed, "a", *k)).alias("insurance_amount")))


def demo_top_states(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Per-state totals over the demo transactions, largest first (top-tier fallback)."""
    return (demo_transactions(spark, seed).groupBy("state")
            .agg(F.sum("transaction_count").alias("total_count"), F.sum("transaction_amount").alias("total_amount"))
            .orderBy(F.col("total_amount").desc(), "state"))


# ---- business-case tables (S21-S25): growth trends and weights --------------------------

def _year_factor(rate: float) -> Column:
    return F.lit(1.0) + (F.col("year") - F.lit(FIRST_YEAR)).cast("double") * F.lit(rate)


def case_transactions(spark: SparkSession, seed: int = 42) -> DataFrame:
    g = _grid(spark, state=CASE_STATES, year=YEARS, quarter=QUARTERS, transaction_type=CASE_CATEGORIES)
    k = ["state", "year", "quarter", "transaction_type"]
    base = (_int_between(*TXN_BASE_MILLIONS, _u(seed, "base", "state")) * F.lit(1_000_000)).cast("double")
    yf, cf = _year_factor(TXN_GROWTH), _weight("transaction_type", CATEGORY_WEIGHT)
    noise = F.lit(TXN_NOISE[0]) + _u(seed, "n", *k) * F.lit(TXN_NOISE[1])
    return _typed(g.select(*k,
                           (_int_between(*TXN_COUNT, _u(seed, "c", *k)).cast("double") * yf * cf)
                           .cast("bigint").alias("transaction_count"),
                           F.floor(base * cf * yf * noise).cast("bigint").alias("transaction_amount")))


def case_users(spark: SparkSession, seed: int = 42) -> DataFrame:
    g = _grid(spark, state=CASE_STATES, year=YEARS, quarter=QUARTERS, brand=CASE_BRANDS)
    sq = ["state", "year", "quarter"]
    base = _int_between(*USER_BASE, _u(seed, "base", "state")).cast("double")
    reg = F.floor(base * _year_factor(USER_GROWTH) * (F.lit(USER_NOISE[0]) + _u(seed, "r", *sq) * F.lit(USER_NOISE[1])))
    g = g.withColumn("registered_users", reg.cast("bigint"))
    opens = F.floor(F.col("registered_users") * (F.lit(OPENS_PER_USER[0]) + _u(seed, "o", *sq) * F.lit(OPENS_PER_USER[1])))
    share = F.col("registered_users") * _weight("brand", BRAND_WEIGHT) * (F.lit(BRAND_NOISE[0]) + _u(seed, "u", *sq, "brand") * F.lit(BRAND_NOISE[1]))
    return _typed(g.select(*sq, "brand", F.floor(share).cast("bigint").alias("user_count"), "registered_users",
                           opens.cast("bigint").alias("app_opens")))


def case_insurance(spark: SparkSession, seed: int = 42) -> DataFrame:
    g = _grid(spark, state=CASE_STATES, year=YEARS, quarter=QUARTERS)
    k = ["state", "year", "quarter"]
    base = _int_between(*POLICY_BASE, _u(seed, "base", "state")).cast("double")
    cnt = F.floor(base * _year_factor(POLICY_GROWTH) * (F.lit(POLICY_NOISE[0]) + _u(seed, "c", *k) * F.lit(POLICY_NOISE[1]))).cast("bigint")
    g = g.withColumn("insurance_count", cnt)
    return _typed(g.select(*k, "insurance_count",
                           (F.col("insurance_count") * _int_between(*PREMIUM, _u(seed, "p", *k)))
                           .alias("insurance_amount")))


def case_map(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Each state: its own district plus two drawn districts (a draw may repeat)."""
    pairs = list(zip(CASE_STATES, CASE_DISTRICTS))
    g = (spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(d).alias("home"))
                                                   for s, d in pairs])).alias("p"))
         .select("p.*").select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot")))
    pick = F.element_at(F.array(*[F.lit(d) for d in CASE_DISTRICTS]),
                        (_int_between(0, len(CASE_DISTRICTS), _u(seed, "d", "state", "slot")) + 1).cast("int"))
    g = g.withColumn("district", F.when(F.col("slot") == 0, F.col("home")).otherwise(pick))
    g = g.select("*", F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"))
    g = g.select("*", F.explode(F.array(*[F.lit(q) for q in QUARTERS])).alias("quarter"))
    k = ["state", "slot", "year", "quarter"]
    base = _int_between(*MAP_BASE, _u(seed, "base", "state")).cast("double")
    home = F.col("slot") == 0
    count = F.when(home, _int_between(*HOME_COUNT, _u(seed, "c", *k))).otherwise(
        _int_between(*AWAY_COUNT, _u(seed, "c", *k)))
    amount = F.when(home, F.floor(base * (F.lit(MAP_NOISE[0]) + _u(seed, "a", *k) * F.lit(MAP_NOISE[1]))).cast("bigint")).otherwise(
        _int_between(*AWAY_AMOUNT, _u(seed, "a", *k)))
    return _typed(g.select("state", "district", "year", "quarter", count.alias("transaction_count"),
                           amount.alias("transaction_amount")))


def case_registrations(spark: SparkSession, seed: int = 42, n_pincodes: int = PINCODES) -> DataFrame:
    """Per state-quarter three distinct districts (drawn without replacement), each
    with a pincode from a pool of ``n_pincodes`` six-digit codes."""
    from pyspark.sql import Window
    g = _grid(spark, state=CASE_STATES, year=YEARS, quarter=QUARTERS, district=CASE_DISTRICTS)
    sq = ["state", "year", "quarter"]
    # 15 candidate districts per state-quarter: a bounded window picks 3 by hash order
    rank = F.row_number().over(Window.partitionBy(*sq).orderBy(F.xxhash64("district", *[F.col(c) for c in sq],
                                                                          F.lit(seed))))
    g = g.withColumn("_r", rank).where(F.col("_r") <= 3).drop("_r")
    k = sq + ["district"]
    pin_idx = _int_between(0, n_pincodes, _u(seed, "pin", *k))
    pincode = _int_between(*PINCODE_RANGE, F.pmod(F.xxhash64(pin_idx, F.lit(seed)), F.lit(1_000_003))
                           .cast("double") / F.lit(1_000_003.0)).cast("string")
    return _typed(g.select("state", "district", pincode.alias("pincode"), "year", "quarter",
                           _int_between(*REGISTRATIONS, _u(seed, "r", *k)).alias("registered_users")))


class SyntheticTables:
    """Table interface of the synthetic data (demo mode), mirroring ``DerivedTables``."""

    def __init__(self, spark: SparkSession, seed: int = 42, case: bool = True):
        self.spark, self.seed, self.case = spark, seed, case

    @property
    def aggregated_transaction(self) -> DataFrame:
        return case_transactions(self.spark, self.seed) if self.case else demo_transactions(self.spark, self.seed)

    @property
    def aggregated_user(self) -> DataFrame:
        return case_users(self.spark, self.seed) if self.case else demo_users(self.spark)

    @property
    def aggregated_insurance(self) -> DataFrame:
        return case_insurance(self.spark, self.seed) if self.case else demo_insurance(self.spark)

    @property
    def map_transaction(self) -> DataFrame:
        return case_map(self.spark, self.seed)

    @property
    def top_user(self) -> DataFrame:
        return case_registrations(self.spark, self.seed)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
