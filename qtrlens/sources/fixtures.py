"""The nine tables derived from the driver's TPC-H-style tables (FIXTURES.md §A).

Mapping: state = nation name, district = customer market segment, pincode = customer
key, year/quarter from the order date, transaction type = order priority, brand =
part type, insurance = returned line items.

Everything is lazy: a query that needs one table only scans and joins what that table
needs, with column pruning and filter pushdown into the Parquet scans. Scale notes:
* ``nation`` is a fixed 25-row dimension; it is broadcast behind a size check.
* orders x customer and lineitem x orders are shuffle joins on their keys (AQE may
  turn them into broadcasts when a side is small at runtime, and splits skewed keys).
* the two-level tables (``top_*``) use grouping sets over rows that are already aggregated
  at the finest grain, ``aggregated_user`` marks one row per customer: one scan serves
  both grains, and no order or line item is expanded.
* only the tables with a brand join ``part``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qtrlens.functions.joins import broadcast_if_small

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

MONEY = "decimal(20,2)"

_SCHEMA_CACHE: dict[str, "object"] = {}


def clear_schema_cache() -> None:
    """Forget inferred driver-table schemas (after replacing files in place)."""
    _SCHEMA_CACHE.clear()


def _money_sum(c: str) -> F.Column:
    return F.sum(c).cast(MONEY)


class DerivedTables:
    """Lazy DataFrames of the nine tables built from ``sf_dir``'s Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._first_year: F.Column | None = None

    def newest(self, n: int, years: DataFrame) -> "DerivedTables":
        """The same tables from the orders of the ``n`` newest of ``years`` on (the pages' default selection).

        The first year is a scalar subquery that bounds the order date at the scan, below all joins:
        older orders meet neither customers nor line items."""
        from qtrlens.operators.filters import newest_years
        other = DerivedTables(self.spark, self.sf_dir)
        other._first_year = newest_years(years, n).agg(F.min("year").alias("year")).scalar()
        return other

    def raw(self, name: str) -> DataFrame:
        """A driver table. Its Parquet schema is inferred once per path and then passed
        to the reader (footer reads cost ~0.15 s per table per query); the file listing
        still runs on every read, so new files are picked up."""
        path = f"{self.sf_dir}/{name}.parquet"
        schema = _SCHEMA_CACHE.get(path)
        if schema is None:
            df = self.spark.read.parquet(path)
            _SCHEMA_CACHE[path] = df.schema
            return df
        return self.spark.read.schema(schema).parquet(path)

    # ---- helper grains ----------------------------------------------------------

    @cached_property
    def fx_order(self) -> DataFrame:
        """One row per order with its place, period, category and amount.

        Written as one ``spark.sql`` over the raw DataFrames (a single analysis instead of
        one per DataFrame step). The 25-row nation dimension gets a broadcast hint only if
        its size estimate passes ``broadcast_if_small``'s check; the other joins are left
        to the planner and AQE.
        """
        n = self.raw("nation")
        hint = "/*+ BROADCAST(n) */ " if broadcast_if_small(n) is not n else ""
        return self.spark.sql(f"""
            select {hint}o.o_orderkey, n.n_name as state, c.c_mktsegment as district,
                   cast(c.c_custkey as string) as pincode,
                   cast(year(o.o_orderdate) as smallint) as year, cast(quarter(o.o_orderdate) as int) as quarter,
                   o.o_orderpriority as transaction_type, cast(o.o_totalprice as {MONEY}) as amount, o.o_custkey
            from {{o}} o join {{c}} c on o.o_custkey = c.c_custkey join {{n}} n on c.c_nationkey = n.n_nationkey""",
                              o=self._orders(), c=self.raw("customer"), n=n)

    def _orders(self) -> DataFrame:
        orders = self.raw("orders")
        if self._first_year is None:
            return orders
        return orders.where(F.col("o_orderdate") >= F.make_date(self._first_year.cast("int"), F.lit(1), F.lit(1)))

    @cached_property
    def fx_sale(self) -> DataFrame:
        """One row per line item, carrying its order's attributes.

        Line items are the largest table at any size: the hint keeps them (or the orders) from
        being broadcast where an estimate of their pruned columns looks small."""
        return self.spark.sql(f"""
            select /*+ MERGE(l) */ f.*, l.l_partkey, l.l_returnflag, cast(l.l_extendedprice as {MONEY}) as ext
            from {{f}} f join {{l}} l on l.l_orderkey = f.o_orderkey""", f=self.fx_order, l=self.raw("lineitem"))

    @cached_property
    def fx_line(self) -> DataFrame:
        """One row per line item with the device brand."""
        return self.spark.sql("select s.*, p.p_type as brand from {s} s join {p} p on s.l_partkey = p.p_partkey",
                              s=self.fx_sale, p=self.raw("part"))

    def once(self) -> "DerivedTables":
        """The same tables, with those made of line items read from one aggregate of them.

        Queries that join users with insurance derive both from orders and line items. Here one pass
        counts a state-quarter's lines by customer and brand, and keeps a row per brand: states x
        quarters x brands rows, whatever the size of the data. It is checkpointed, so each table
        is a projection or a small aggregate of it."""
        return self._once

    @cached_property
    def _once(self) -> "DerivedTables":
        from qtrlens.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        sq, returned = ["state", "year", "quarter"], F.col("l_returnflag") == "R"
        fine = self.fx_line.groupBy(*sq, "o_custkey", "brand").agg(
            F.count(F.lit(1)).alias("lines"), F.count_if(returned).alias("policies"), F.sum(F.when(returned, F.col("ext"))).alias("premium"))
        one = F.row_number().over(Window.partitionBy(*sq, "o_custkey").orderBy("brand")) == 1
        facts = (fine.withColumn("customer", one.cast("bigint")).groupBy(*sq, "brand")
                 .agg(F.count(F.lit(1)).alias("user_count"), *[F.sum(c).alias(c) for c in ("customer", "lines", "policies", "premium")]).checkpoint())
        total = Window.partitionBy(*sq)
        other = DerivedTables(self.spark, self.sf_dir)
        other._first_year = self._first_year
        by_quarter = facts.groupBy(*sq).agg(F.sum("customer").alias("registered_users"), F.sum("lines").alias("app_opens"),
                                            F.sum("policies").alias("insurance_count"), _money_sum("premium").alias("insurance_amount"))
        other.__dict__.update(
            aggregated_user=facts.select(*sq, "brand", "user_count", F.sum("customer").over(total).alias("registered_users"),
                                         F.sum("lines").over(total).alias("app_opens")),
            user_totals=by_quarter.select(*sq, "registered_users", "app_opens"),
            aggregated_insurance=by_quarter.where("insurance_count > 0").select(*sq, "insurance_count", "insurance_amount"))
        return other

    @cached_property
    def transaction_years(self) -> DataFrame:
        """The years of the transaction tables, from the order dates alone."""
        return self.raw("orders").select(F.year("o_orderdate").cast("smallint").alias("year"))

    @cached_property
    def insurance_years(self) -> DataFrame:
        """The years of the insurance tables: no amounts, customers or brands are read."""
        returned = self.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
        dated = self.raw("orders").select("o_orderkey", F.year("o_orderdate").cast("smallint").alias("year"))
        return dated.join(returned, "o_orderkey", "left_semi").select("year")

    # ---- the nine tables ----------------------------------------------------------

    @cached_property
    def aggregated_transaction(self) -> DataFrame:
        return (self.fx_order.groupBy("state", "year", "quarter", "transaction_type")
                .agg(F.count(F.lit(1)).alias("transaction_count"), _money_sum("amount").alias("transaction_amount")))

    @cached_property
    def aggregated_user(self) -> DataFrame:
        # One scan of the line items, first aggregated per customer and brand of a
        # state-quarter: a brand's distinct customers are then rows to count. One row of each
        # customer is marked as its first, so the state-quarter's distinct customers are
        # the marks to add up. The totals meet their brand rows in a window over the
        # state-quarter (a row per brand). No Expand and no distinct aggregate; who reads
        # brands only pays neither for the marks nor for the totals (both are pruned).
        sq = ["state", "year", "quarter"]
        fine = self.fx_line.groupBy(*sq, "o_custkey", "brand").agg(F.count(F.lit(1)).alias("lines"))
        one = F.row_number().over(Window.partitionBy(*sq, "o_custkey").orderBy("brand")) == 1
        by_brand = (fine.withColumn("customer", one.cast("bigint")).groupBy(*sq, "brand")
                    .agg(F.count(F.lit(1)).alias("user_count"), F.sum("customer").alias("customers"), F.sum("lines").alias("lines")))
        total = Window.partitionBy(*sq)
        return by_brand.select(*sq, "brand", "user_count", F.sum("customers").over(total).alias("registered_users"),
                               F.sum("lines").over(total).alias("app_opens"))

    @cached_property
    def user_totals(self) -> DataFrame:
        """``aggregated_user`` de-duplicated to one row per (state, year, quarter).

        Same rows as ``dedup_users(aggregated_user)`` (every state-quarter of the table
        has at least one brand row), computed at that grain alone: one aggregate, no
        brand grouping set and no window. Operators that only read de-duplicated users
        accept it in place of the full table (de-duplicating it again is a no-op).
        """
        return (self.fx_sale
                .groupBy("state", "year", "quarter")
                .agg(F.count_distinct("o_custkey").alias("registered_users"), F.count(F.lit(1)).alias("app_opens")))

    @cached_property
    def aggregated_insurance(self) -> DataFrame:
        return (self.fx_sale.where(F.col("l_returnflag") == "R").groupBy("state", "year", "quarter")
                .agg(F.count(F.lit(1)).alias("insurance_count"), _money_sum("ext").alias("insurance_amount")))

    @cached_property
    def map_transaction(self) -> DataFrame:
        return (self.fx_order.groupBy("state", "district", "year", "quarter")
                .agg(F.count(F.lit(1)).alias("transaction_count"), _money_sum("amount").alias("transaction_amount")))

    @cached_property
    def map_user(self) -> DataFrame:
        return (self.fx_sale.groupBy("state", "district", "year", "quarter")
                .agg(F.count_distinct("o_custkey").alias("registered_users"),
                     F.count(F.lit(1)).alias("app_opens")))

    @cached_property
    def map_insurance(self) -> DataFrame:
        return (self.fx_sale.where(F.col("l_returnflag") == "R").groupBy("state", "district", "year", "quarter")
                .agg(F.count(F.lit(1)).alias("insurance_count"), _money_sum("ext").alias("insurance_amount")))

    @staticmethod
    def _two_levels(src: DataFrame, *aggs: F.Column) -> DataFrame:
        """District rows and pincode rows of the top tier in one pass.

        GROUPING SETS (state, district, period) and (state, pincode, period): columns
        outside a set come out NULL, which is exactly the union of the two levels. ``src``
        is already aggregated by place and period, so the Expand doubles those rows only;
        no second scan and no union.
        """
        keys = ["state", "district", "pincode", "year", "quarter"]
        g = src.groupingSets([["state", "district", "year", "quarter"], ["state", "pincode", "year", "quarter"]],
                             *keys).agg(*aggs)
        return g.select(*keys, *[c for c in g.columns if c not in keys])

    _TOP_SOURCES = {
        "top_transaction": ("fx_order", None, lambda: [F.count(F.lit(1)).alias("transaction_count"),
                                                         _money_sum("amount").alias("transaction_amount")]),
        "top_user": ("fx_order", None, lambda: [F.count_distinct("o_custkey").alias("registered_users")]),
        "top_insurance": ("fx_sale", "R", lambda: [F.count(F.lit(1)).alias("insurance_count"),
                                                    _money_sum("ext").alias("insurance_amount")]),
    }

    def top_level(self, table: str, level: str) -> DataFrame:
        """Only the ``district`` or only the ``pincode`` rows of a top-tier table.

        Same rows as ``table.where(level IS NOT NULL)`` but aggregated at that one grain:
        a filter after GROUPING SETS cannot drop the other set, so a one-level query
        would otherwise compute both grains.
        """
        src_name, flag, aggs = self._TOP_SOURCES[table]
        src = getattr(self, src_name)
        if flag:
            src = src.where(F.col("l_returnflag") == flag)
        other = "pincode" if level == "district" else "district"
        g = (src.groupBy("state", level, "year", "quarter").agg(*aggs())
             .withColumn(other, F.lit(None).cast("string")))
        keys = ["state", "district", "pincode", "year", "quarter"]
        return g.select(*keys, *[c for c in g.columns if c not in keys]).where(F.col(level).isNotNull())

    _PLACE = ("state", "district", "pincode", "year", "quarter")

    @cached_property
    def top_transaction(self) -> DataFrame:
        fine = self.fx_order.groupBy(*self._PLACE).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        return self._two_levels(fine, F.sum("n").alias("transaction_count"),
                                _money_sum("amount").alias("transaction_amount"))

    @cached_property
    def top_user(self) -> DataFrame:
        # the pincode is the customer: a place's distinct rows are its customers, and a
        # pincode has one
        fine = self.fx_order.select(*self._PLACE).distinct()
        return self._two_levels(fine, F.when(F.grouping("pincode") == 0, F.lit(1)).otherwise(F.count(F.lit(1))).cast("bigint").alias("registered_users"))

    @cached_property
    def top_insurance(self) -> DataFrame:
        fine = (self.fx_sale.where(F.col("l_returnflag") == "R").groupBy(*self._PLACE)
                .agg(F.count(F.lit(1)).alias("n"), F.sum("ext").alias("ext")))
        return self._two_levels(fine, F.sum("n").alias("insurance_count"),
                                _money_sum("ext").alias("insurance_amount"))

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def staged(self, names: list[str] | None = None) -> "DerivedTables":
        """The same tables over checkpoints of the order facts and, if one of ``names`` (default: all)
        needs them, the line facts: derived once, however many tables are built of them."""
        from qtrlens.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        staged = DerivedTables(self.spark, self.sf_dir)
        staged.__dict__["fx_order"] = self.fx_order.checkpoint(eager=True)
        if names is None or any(n in ("aggregated_user", "aggregated_insurance", "map_user", "map_insurance", "top_insurance") for n in names):
            staged.__dict__["fx_line"] = staged.__dict__["fx_sale"] = self.fx_line.checkpoint(eager=True)
        return staged

    def materialize(self, out_dir: str | None = None, tables: list[str] | None = None,
                    parallel: int = 1) -> "StoredTables":
        """ETL: write the nine tables once, as Parquet partitioned by ``year``.

        The two shared join grains (order-level and line-level facts) are checkpointed
        first: a reliable checkpoint in ``spark.checkpoint.dir`` cuts their lineage, so
        the tables built from them read the checkpoint instead of re-joining line items
        five times, and a lost executor costs a re-read, not a re-join. The default
        output folder is under the shared checkpoint folder too. ``parallel`` > 1 writes
        that many tables concurrently (independent jobs submitted from driver threads).
        """
        from qtrlens.schemas import TABLES
        from qtrlens.session import ensure_checkpoint_dir
        from qtrlens.sinks import write_table
        root = ensure_checkpoint_dir(self.spark).rstrip("/")
        out = (out_dir or f"{root}/tables").rstrip("/")
        names = tables or TABLES
        staged = self.staged(names)
        from qtrlens.sinks import run_jobs
        done = run_jobs({n: (lambda n=n: write_table(staged.table(n), f"{out}/{n}")) for n in names}, parallel)
        failed = {n: e for n, (_, e) in done.items() if e}
        if failed:
            raise RuntimeError(f"materialize failed for {sorted(failed)}: {failed}")
        self.rows_written = {n: r for n, (r, _) in done.items()}
        return StoredTables(self.spark, out)


    def bucketed(self, names: list[str] | None = None, prefix: str | None = None, buckets: int = 8) -> "BucketedTables":
        """Write tables (default: all nine) to the session's catalog, partitioned by year and bucketed by
        state, under names that start with ``prefix`` (default: a fresh one).

        The state tables have at most a row per state, quarter and brand or district. The top tier has a
        row per pincode and is bucketed by state and place, so that no bucket holds a whole state."""
        import uuid

        from qtrlens.schemas import TABLES
        prefix = prefix or f"qtrlens_{uuid.uuid4().hex}"
        names = names or TABLES
        staged = self.staged(names)
        for name in names:
            by = ["state", "pincode"] if name.startswith("top_") else ["state"]
            (staged.table(name).write.partitionBy("year").bucketBy(buckets, *by).sortBy(*by)
             .mode("overwrite").format("parquet").saveAsTable(f"{prefix}_{name}"))
        return BucketedTables(self.spark, prefix)


class StoredTables:
    """The nine tables read back from Parquet (same interface as ``DerivedTables``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._first_year: F.Column | None = None

    def table(self, name: str) -> DataFrame:
        from qtrlens.sinks import read_table
        rows = read_table(self.spark, f"{self.root}/{name}", name)
        return rows if self._first_year is None else rows.where(F.col("year") >= self._first_year)

    def newest(self, n: int, years: DataFrame) -> "StoredTables":
        """The same tables from the ``n`` newest of ``years`` on; older ``year`` partitions are not read."""
        from qtrlens.operators.filters import newest_years
        other = StoredTables(self.spark, self.root)
        other._first_year = newest_years(years, n).agg(F.min("year").alias("year")).scalar()
        return other

    def once(self) -> "StoredTables":
        return self

    def top_level(self, table: str, level: str) -> DataFrame:
        return self.table(table).where(F.col(level).isNotNull())

    @property
    def user_totals(self) -> DataFrame:
        from qtrlens.functions.aggs import dedup_users
        return dedup_users(self.aggregated_user)

    @property
    def transaction_years(self) -> DataFrame:
        return self.table("aggregated_transaction").select("year")

    @property
    def insurance_years(self) -> DataFrame:
        return self.table("aggregated_insurance").select("year")

    def __getattr__(self, name: str) -> DataFrame:
        from qtrlens.schemas import TABLE_SCHEMAS
        if name in TABLE_SCHEMAS:
            return self.table(name)
        raise AttributeError(name)


class BucketedTables(StoredTables):
    """Tables of the session's catalog that ``DerivedTables.bucketed`` has written."""

    def table(self, name: str) -> DataFrame:
        from qtrlens.sources.ingest import conform
        rows = conform(self.spark.table(f"{self.root}_{name}"), name)
        return rows if self._first_year is None else rows.where(F.col("year") >= self._first_year)

    def newest(self, n: int, years: DataFrame) -> "BucketedTables":
        other = BucketedTables(self.spark, self.root)
        other._first_year = StoredTables.newest(self, n, years)._first_year
        return other

    def drop(self) -> None:
        """Remove the tables."""
        from qtrlens.schemas import TABLES
        for name in TABLES:
            self.spark.sql(f"drop table if exists `{self.root}_{name}`")


# ---- the same definitions as SQL text (DuckDB oracle; FIXTURES.md §A) --------------
# The oracle inlines these as leading CTEs, since DuckDB only knows the driver tables.

FIXTURE_SQL: dict[str, str] = {
    "fx_order": """select o.o_orderkey, n.n_name as state, c.c_mktsegment as district, cast(c.c_custkey as varchar(20)) as pincode,
  cast(year(o.o_orderdate) as smallint) as year, cast(quarter(o.o_orderdate) as int) as quarter, o.o_orderpriority as transaction_type,
  cast(o.o_totalprice as decimal(20,2)) as amount, o.o_custkey
  from orders o join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey""",
    "fx_line": """select f.*, p.p_type as brand, l.l_returnflag, cast(l.l_extendedprice as decimal(20,2)) as ext
  from fx_order f join lineitem l on l.l_orderkey=f.o_orderkey join part p on l.l_partkey=p.p_partkey""",
    "aggregated_transaction": """select state,year,quarter,transaction_type,count(*) as transaction_count,cast(sum(amount) as decimal(20,2)) as transaction_amount from fx_order group by state,year,quarter,transaction_type""",
    "aggregated_user": """select b.state,b.year,b.quarter,b.brand,b.user_count,t.registered_users,t.app_opens from
  (select state,year,quarter,brand,count(distinct o_custkey) as user_count from fx_line group by state,year,quarter,brand) b
  join (select state,year,quarter,count(distinct o_custkey) as registered_users,count(*) as app_opens from fx_line group by state,year,quarter) t
  on b.state=t.state and b.year=t.year and b.quarter=t.quarter""",
    "aggregated_insurance": """select state,year,quarter,count(*) as insurance_count,cast(sum(ext) as decimal(20,2)) as insurance_amount from fx_line where l_returnflag='R' group by state,year,quarter""",
    "map_transaction": """select state,district,year,quarter,count(*) as transaction_count,cast(sum(amount) as decimal(20,2)) as transaction_amount from fx_order group by state,district,year,quarter""",
    "map_user": """select state,district,year,quarter,count(distinct o_custkey) as registered_users,count(*) as app_opens from fx_line group by state,district,year,quarter""",
    "map_insurance": """select state,district,year,quarter,count(*) as insurance_count,cast(sum(ext) as decimal(20,2)) as insurance_amount from fx_line where l_returnflag='R' group by state,district,year,quarter""",
    "top_transaction": """select state,district,cast(null as varchar(20)) as pincode,year,quarter,count(*) as transaction_count, cast(sum(amount) as decimal(20,2)) as transaction_amount from fx_order group by state,district,year,quarter
  union all select state,cast(null as varchar(200)) as district,pincode,year,quarter,count(*) as transaction_count, cast(sum(amount) as decimal(20,2)) as transaction_amount from fx_order group by state,pincode,year,quarter""",
    "top_user": """select state,district,cast(null as varchar(20)) as pincode,year,quarter,count(distinct o_custkey) as registered_users from fx_order group by state,district,year,quarter
  union all select state,cast(null as varchar(200)) as district,pincode,year,quarter,count(distinct o_custkey) as registered_users from fx_order group by state,pincode,year,quarter""",
    "top_insurance": """select state,district,cast(null as varchar(20)) as pincode,year,quarter,count(*) as insurance_count, cast(sum(ext) as decimal(20,2)) as insurance_amount from (select * from fx_line where l_returnflag='R') x group by state,district,year,quarter
  union all select state,cast(null as varchar(200)) as district,pincode,year,quarter,count(*) as insurance_count, cast(sum(ext) as decimal(20,2)) as insurance_amount from (select * from fx_line where l_returnflag='R') x group by state,pincode,year,quarter""",
}


def with_fixture_ctes(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it needs as CTEs (merging its own WITH)."""
    body = sql.strip().rstrip(";")
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        deps = FIXTURE_SQL[name]
        for dep in FIXTURE_SQL:
            if dep != name and dep in ("fx_order", "fx_line") and f" {dep} " in f" {deps} ".replace("\n", " "):
                need(dep)
        needed.append(name)

    text = " " + body.replace("\n", " ").replace(",", " , ").replace("(", " ( ").replace(")", " ) ") + " "
    for name in FIXTURE_SQL:
        if f" {name} " in text:
            need(name)
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in needed)
    if not ctes:
        return body
    if body[:4].lower() == "with":
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"
