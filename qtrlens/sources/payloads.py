"""Table rows -> JSON payloads in the source layout (the inverse of ingest).

Used to exercise ingest end to end on data derived from the driver tables: payloads
are built per (state, year, quarter) like the source files, serialised with
``to_json``, then parsed back with the fixed schema and flattened. Nested lists are
bounded per file: categories, brands and districts per state-quarter. Pincode
entries (unbounded per state) are emitted one per payload, i.e. as many small files,
so no group ever collects an unbounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtrlens.sources.ingest import SOURCES


def slug(state: Column | str = "state") -> Column:
    c = F.col(state) if isinstance(state, str) else state
    return F.lower(F.regexp_replace(c, " ", "-"))


def file_path(table: str, root: str = "/payloads") -> Column:
    base = SOURCES[table].base(root)
    return F.concat(F.lit(base + "/"), slug(), F.lit("/"), F.col("year").cast("string"), F.lit("/"),
                    F.col("quarter").cast("string"), F.lit(".json"))


def _ca(count: str, amount: str) -> Column:
    return F.struct(F.col(count).alias("count"), F.col(amount).alias("amount"))


def _wrap(df: DataFrame, table: str, data: Column, root: str = "/payloads") -> DataFrame:
    return df.select(file_path(table, root).alias("file_path"), F.to_json(F.struct(data.alias("data"))).alias("json"))


def _entry(table: str):
    """Name -> a place's entry in the top tier's lists."""
    if table == "top_user":
        return lambda name: F.struct(F.col(name).alias("name"), F.col("registered_users").alias("registeredUsers"))
    c, a = (("transaction_count", "transaction_amount") if table == "top_transaction"
            else ("insurance_count", "insurance_amount"))
    return lambda name: F.struct(F.col(name).alias("entityName"), _ca(c, a).alias("metric"))


def payloads(df: DataFrame, table: str, levels: tuple[DataFrame, DataFrame] | None = None,
             root: str = "/payloads") -> DataFrame:
    """``(file_path, json)`` rows in the source's payload shape for ``table``, as of files under ``root``.

    For the top tier, ``levels`` may give the district rows and the pincode rows as two
    frames (each computed at its own grain) instead of splitting ``df`` by level.
    """
    k = ["state", "year", "quarter"]
    if table == "aggregated_transaction":
        g = df.groupBy(*k).agg(F.collect_list(F.struct(
            F.col("transaction_type").alias("name"),
            F.array(_ca("transaction_count", "transaction_amount")).alias("paymentInstruments"))).alias("l"))
        return _wrap(g, table, F.struct(F.col("l").alias("transactionData")), root)
    if table == "aggregated_user":
        g = df.groupBy(*k).agg(F.max("registered_users").alias("r"), F.max("app_opens").alias("o"),
                               F.collect_list(F.struct(F.col("brand").alias("brand"),
                                                       F.col("user_count").alias("count"))).alias("l"))
        return _wrap(g, table, F.struct(
            F.struct(F.col("r").alias("registeredUsers"), F.col("o").alias("appOpens")).alias("aggregated"),
            F.col("l").alias("usersByDevice")), root)
    if table == "aggregated_insurance":
        one = F.array(F.struct(F.lit("Insurance").alias("name"),
                               F.array(_ca("insurance_count", "insurance_amount")).alias("paymentInstruments")))
        return _wrap(df, table, F.struct(one.alias("transactionData")), root)
    if table in ("map_transaction", "map_insurance"):
        c, a = (("transaction_count", "transaction_amount") if table == "map_transaction"
                else ("insurance_count", "insurance_amount"))
        g = df.groupBy(*k).agg(F.collect_list(F.struct(
            F.col("district").alias("name"), F.array(_ca(c, a)).alias("metric"))).alias("l"))
        return _wrap(g, table, F.struct(F.col("l").alias("hoverDataList")), root)
    if table == "map_user":
        # JSON object keys cannot be null: a NULL district has no place in the source format
        district = F.coalesce("district", F.raise_error(F.lit("map_user: null district")).cast("string"))
        g = df.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct(
            district.alias("district"), F.struct(F.col("registered_users").alias("registeredUsers"),
                                        F.col("app_opens").alias("appOpens"))))).alias("m"))
        return _wrap(g, table, F.struct(F.col("m").alias("hoverData")), root)
    if table in ("top_transaction", "top_insurance", "top_user"):
        entry = _entry(table)
        d_rows, p_rows = levels if levels else (df.where(F.col("pincode").isNull()), df.where(F.col("pincode").isNotNull()))
        dist = d_rows.groupBy(*k).agg(F.collect_list(entry("district")).alias("d"))
        # the other level's list is empty: an empty slice keeps the element type
        dist = dist.withColumn("p", F.slice(F.col("d"), 1, 0))
        pins = p_rows.select(*k, F.array(entry("pincode")).alias("p"))
        pins = pins.withColumn("d", F.slice(F.col("p"), 1, 0))
        both = dist.unionByName(pins)
        return _wrap(both, table, F.struct(F.col("d").alias("districts"), F.col("p").alias("pincodes")), root)
    raise ValueError(f"unknown table {table}")


def top_payload_parts(df: DataFrame, table: str, places: int, root: str = "/payloads") -> DataFrame:
    """``(file_path, json)`` of the top tier with districts and pincodes of a state-quarter together, in
    as many parts as it takes for about ``places`` entries in each (a part is a file of its own)."""
    k = ["state", "year", "quarter"]
    place = F.coalesce("district", "pincode")
    counts = df.groupBy(*k).agg(F.count("*").alias("n"))
    rows = df.join(counts, k).withColumn("part", F.expr(f"cast(pmod(xxhash64(coalesce(district, pincode)), 1 + (n - 1) div {int(places)}) as int)"))
    entry = _entry(table)
    g = rows.where(place.isNotNull()).groupBy(*k, "part").agg(
        F.collect_list(F.when(F.col("district").isNotNull(), entry("district"))).alias("d"),
        F.collect_list(F.when(F.col("district").isNull(), entry("pincode"))).alias("p"))
    data = F.struct(F.col("d").alias("districts"), F.col("p").alias("pincodes"))
    first, other = file_path(table, root), F.concat(F.lit("."), F.col("part").cast("string"), F.lit(".json"))
    path = F.when(F.col("part") == 0, first).otherwise(F.concat(F.regexp_replace(first, "[.]json$", ""), other))
    return g.select(path.alias("file_path"), F.to_json(F.struct(data.alias("data"))).alias("json"))


def parse_payloads(p: DataFrame, table: str) -> DataFrame:
    """``(file_path, json)`` -> parsed rows with state/year/quarter from the path."""
    from qtrlens.sources.ingest import with_path_keys
    parsed = p.select("file_path", F.from_json("json", SOURCES[table].payload).alias("j"))
    return with_path_keys(parsed.select("file_path", F.col("j.data").alias("data")))


def round_trip(df: DataFrame, table: str, levels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Table -> payload JSON -> parse -> flatten -> table (state becomes the path's title)."""
    from qtrlens.sources.ingest import FLATTEN, conform
    return conform(FLATTEN[table](parse_payloads(payloads(df, table, levels), table)), table)
