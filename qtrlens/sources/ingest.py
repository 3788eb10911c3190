"""Ingest: trees of quarterly JSON files -> the nine tables.

Layout: ``<root>/data/<tier>/<kind>[/hover]/country/india/state/<slug>/<year>/<q>.json``.
State, year and quarter come from the file path; the payload is read with a fixed
schema (never inferred). Every ``flatten_*`` function is a plain DataFrame transform
from parsed payload rows ``(state, year, quarter, data)`` to table rows, so the same
code serves batch reads, the incremental stream and in-memory round trips.

Tolerance: one bad record never loses a table. Missing counts/amounts default to 0
(as the source does for absent keys), NULL lists explode to nothing, an empty list of
instruments gives 0 instead of failing, and files that do not parse go to
``quarantine`` instead of the table.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qtrlens import schemas as S
from qtrlens.functions.expr import slug_to_title

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"
#: A quarter's file may come in numbered parts: ``1.json``, ``1.2.json``.
PATH_RE = r"/state/([^/]+)/([0-9]{4})/([0-9]+)(?:\.[0-9]+)?\.json$"


@dataclass(frozen=True)
class Source:
    """Where a table's files live and how their payload looks."""
    table: str
    tier: str
    kind: str
    hover: bool
    payload: T.StructType

    def base(self, root: str) -> str:
        mid = f"{self.tier}/{self.kind}" + ("/hover" if self.hover else "")
        return f"{root.rstrip('/')}/data/{mid}/country/india/state"


SOURCES: dict[str, Source] = {
    "aggregated_transaction": Source("aggregated_transaction", "aggregated", "transaction", False, S.PAYLOAD_TRANSACTION),
    "aggregated_user": Source("aggregated_user", "aggregated", "user", False, S.PAYLOAD_USER),
    "aggregated_insurance": Source("aggregated_insurance", "aggregated", "insurance", False, S.PAYLOAD_TRANSACTION),
    "map_transaction": Source("map_transaction", "map", "transaction", True, S.PAYLOAD_HOVER_LIST),
    "map_user": Source("map_user", "map", "user", True, S.PAYLOAD_HOVER_MAP),
    "map_insurance": Source("map_insurance", "map", "insurance", True, S.PAYLOAD_HOVER_LIST),
    "top_transaction": Source("top_transaction", "top", "transaction", False, S.PAYLOAD_TOP_METRIC),
    "top_user": Source("top_user", "top", "user", False, S.PAYLOAD_TOP_USER),
    "top_insurance": Source("top_insurance", "top", "insurance", False, S.PAYLOAD_TOP_METRIC),
}


# ---- path parsing ---------------------------------------------------------------------

def with_path_keys(df: DataFrame, path: Column | str = "file_path") -> DataFrame:
    """Add state (title-cased slug), year and quarter parsed from the file path (of another
    path: an empty state, null year and quarter)."""
    p = F.col(path) if isinstance(path, str) else path
    p = F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))  # Spark reports file paths percent-encoded
    return (df.withColumn("state", slug_to_title(F.regexp_extract(p, PATH_RE, 1)))
            .withColumn("year", F.regexp_extract(p, PATH_RE, 2).try_cast("smallint"))
            .withColumn("quarter", F.regexp_extract(p, PATH_RE, 3).try_cast("int")))


def _reader_schema(payload: T.StructType) -> T.StructType:
    return T.StructType(list(payload.fields) + [T.StructField(CORRUPT, T.StringType(), True)])


def list_files(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """``(file_path, modified, size)`` of the table's files; their contents are not read. None when
    the tier directory does not exist."""
    base = SOURCES[table].base(root)
    if not _exists(spark, base):
        log.warning("ingest: path not found, %s left empty: %s", table, base)
        return None
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(base)
    return found.select(F.col("_metadata.file_path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def read_payloads(spark: SparkSession, root: str, table: str, since=None) -> DataFrame | None:
    """Parsed payload rows ``(file_path, modified, size, hash, state, year, quarter, data, _corrupt_record)``,
    one per file; with ``since``, of files modified then or later (others are not opened).

    Returns None when the tier directory does not exist. One task reads a group of
    small files (``spark.sql.files.openCostInBytes`` packs them); nothing is collected. A file
    that is blank, no JSON object, or not at ``.../state/<slug>/<year>/<quarter>.json`` has its
    text in ``_corrupt_record``.
    """
    src = SOURCES[table]
    base = src.base(root)
    if not _exists(spark, base):
        log.warning("ingest: path not found, %s left empty: %s", table, base)
        return None
    raw = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").text(base))
    if since is not None:
        raw = raw.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    files = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"),
                       F.col("_metadata.file_size").alias("size"), F.md5("value").alias("hash"), "value")
    text = F.regexp_replace("value", "^\ufeff", "")
    record = F.from_json(text, _reader_schema(src.payload), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    keyed = with_path_keys(files.withColumn("j", record))
    usable = F.col("j").isNotNull() & F.col("year").isNotNull() & F.col("quarter").isNotNull()
    return keyed.select("file_path", "modified", "size", "hash", "state", "year", "quarter", F.col("j.data").alias("data"),
                        F.when(usable, F.col(f"j.{CORRUPT}")).otherwise(F.col("value")).alias(CORRUPT))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], S.TABLE_SCHEMAS[table])


# ---- flatteners: parsed payload -> table rows ----------------------------------------------

def _keys() -> list[Column]:
    return [F.col("state"), F.col("year"), F.col("quarter")]


def _count(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def _amount(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(S.MONEY))


def flatten_aggregated_transaction(p: DataFrame) -> DataFrame:
    """One row per category; the first payment instrument's count and amount."""
    t = p.select(*_keys(), F.explode("data.transactionData").alias("t"))
    pi = F.get(F.col("t.paymentInstruments"), 0)
    return t.select(*_keys(), F.col("t.name").alias("transaction_type"),
                    _count(pi["count"]).alias("transaction_count"), _amount(pi["amount"]).alias("transaction_amount"))


def flatten_aggregated_user(p: DataFrame) -> DataFrame:
    """One row per device brand, repeating the state-quarter totals on each."""
    agg = F.col("data.aggregated")
    u = p.select(*_keys(), _count(agg["registeredUsers"]).alias("registered_users"),
                 _count(agg["appOpens"]).alias("app_opens"), F.explode("data.usersByDevice").alias("b"))
    return u.select(*_keys(), F.col("b.brand").alias("brand"), _count(F.col("b.count")).alias("user_count"),
                    "registered_users", "app_opens")


def flatten_aggregated_insurance(p: DataFrame) -> DataFrame:
    """First instrument of the first entry; files with no entry give no row."""
    lst = F.col("data.transactionData")
    pi = F.get(F.get(lst, 0)["paymentInstruments"], 0)
    return (p.where(F.size(lst) > 0)
            .select(*_keys(), _count(pi["count"]).alias("insurance_count"), _amount(pi["amount"]).alias("insurance_amount")))


def _flatten_hover_list(p: DataFrame, count: str, amount: str) -> DataFrame:
    d = p.select(*_keys(), F.explode("data.hoverDataList").alias("d")).where(F.size("d.metric") > 0)
    m = F.get(F.col("d.metric"), 0)
    return d.select("state", F.col("d.name").alias("district"), "year", "quarter",
                    _count(m["count"]).alias(count), _amount(m["amount"]).alias(amount))


def flatten_map_transaction(p: DataFrame) -> DataFrame:
    return _flatten_hover_list(p, "transaction_count", "transaction_amount")


def flatten_map_insurance(p: DataFrame) -> DataFrame:
    return _flatten_hover_list(p, "insurance_count", "insurance_amount")


def flatten_map_user(p: DataFrame) -> DataFrame:
    """``hoverData`` is an object keyed by district: explode the map."""
    d = p.select(*_keys(), F.explode("data.hoverData").alias("district", "v"))
    return d.select("state", "district", "year", "quarter",
                    _count(F.col("v.registeredUsers")).alias("registered_users"),
                    _count(F.col("v.appOpens")).alias("app_opens"))


def _both_levels(p: DataFrame, name_field: str) -> DataFrame:
    """Explode districts and pincodes in one pass, tagging each entry with its level."""
    def tag(arr: str, level: str) -> Column:
        return F.transform(F.coalesce(F.col(arr), F.array()), lambda x: F.struct(F.lit(level).alias("lvl"), x.alias("e")))
    e = p.select(*_keys(), F.explode(F.concat(tag("data.districts", "d"), tag("data.pincodes", "p"))).alias("x"))
    name = F.col("x.e")[name_field]
    return e.select("state",
                    F.when(F.col("x.lvl") == "d", name).alias("district"),
                    F.when(F.col("x.lvl") == "p", name).alias("pincode"),
                    "year", "quarter", F.col("x.e").alias("e"))


def _flatten_top_metric(p: DataFrame, count: str, amount: str) -> DataFrame:
    e = _both_levels(p, "entityName")
    return e.select("state", "district", "pincode", "year", "quarter",
                    _count(F.col("e.metric.count")).alias(count), _amount(F.col("e.metric.amount")).alias(amount))


def flatten_top_transaction(p: DataFrame) -> DataFrame:
    return _flatten_top_metric(p, "transaction_count", "transaction_amount")


def flatten_top_insurance(p: DataFrame) -> DataFrame:
    return _flatten_top_metric(p, "insurance_count", "insurance_amount")


def flatten_top_user(p: DataFrame) -> DataFrame:
    e = _both_levels(p, "name")
    return e.select("state", "district", "pincode", "year", "quarter",
                    _count(F.col("e.registeredUsers")).alias("registered_users"))


FLATTEN = {
    "aggregated_transaction": flatten_aggregated_transaction,
    "aggregated_user": flatten_aggregated_user,
    "aggregated_insurance": flatten_aggregated_insurance,
    "map_transaction": flatten_map_transaction,
    "map_user": flatten_map_user,
    "map_insurance": flatten_map_insurance,
    "top_transaction": flatten_top_transaction,
    "top_user": flatten_top_user,
    "top_insurance": flatten_top_insurance,
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast to the table's declared schema (column order included)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.TABLE_SCHEMAS[table].fields])


# ---- public entry points -----------------------------------------------------------------

def load_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Table rows from the JSON tree (good files only); empty with schema if no tier dir."""
    p = read_payloads(spark, root, table)
    if p is None:
        return empty_table(spark, table)
    return rows_of(p, table)


def rows_of(payloads: DataFrame, table: str) -> DataFrame:
    """Table rows of the payloads that parsed."""
    return conform(FLATTEN[table](payloads.where(F.col(CORRUPT).isNull())), table)


def quarantine(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every file that ``load_table`` leaves out: path, raw text, and whether a part of it
    could be read. Together the two cover all files."""
    p = read_payloads(spark, root, table)
    if p is None:
        return spark.createDataFrame([], "file_path string, raw string, partly_read boolean")
    return quarantined(p)


def quarantined(payloads: DataFrame) -> DataFrame:
    return payloads.where(F.col(CORRUPT).isNotNull()).select(
        "file_path", F.col(CORRUPT).alias("raw"), F.col("data").isNotNull().alias("partly_read"))
