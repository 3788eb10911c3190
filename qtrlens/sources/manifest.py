"""The manifest of an ingested table: one row per file that the table has been made from.

It lies beside the table in ``_manifest/<table>`` and says of every file what it was like when
it was read (modification time, size, hash), how many rows it gave, and, where it could not be
used, its text. Comparing it with a listing tells new, changed and removed files apart, whatever
their paths were before. A manifest is written as a new version and older ones are
removed after, so a reader always finds a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("file_path string, modified timestamp, size bigint, hash string, state string, year smallint, quarter int, "
          "rows bigint, raw string, partly_read boolean")


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def delete_folder(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return bool(fs.delete(hpath, True))


def _versions(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """(whole versions, all versions), ascending."""
    fs, hpath = _fs(spark, folder)
    if not fs.exists(hpath):
        return [], []
    found = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(hpath) if s.getPath().getName().startswith("v="))
    whole = [v for v in found if fs.exists(_fs(spark, f"{folder}/v={v}/_SUCCESS")[1])]
    return whole, found


def folder_of(out_dir: str, table: str) -> str:
    return f"{out_dir.rstrip('/')}/_manifest/{table}"


def read_manifest(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """The newest whole version; no rows where there is none."""
    folder = folder_of(out_dir, table)
    whole, _ = _versions(spark, folder)
    if not whole:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/v={whole[-1]}")


def write_manifest(manifest: DataFrame, out_dir: str, table: str) -> None:
    spark, folder = manifest.sparkSession, folder_of(out_dir, table)
    _, found = _versions(spark, folder)
    version = max(found, default=0) + 1
    manifest.write.parquet(f"{folder}/v={version}")
    for old in found:
        delete_folder(spark, f"{folder}/v={old}")


def compared(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file of either with its ``status``: new, changed (another time or size), same or removed,
    and with the keys of its path."""
    from qtrlens.sources.ingest import with_path_keys

    old = manifest.select("file_path", F.col("modified").alias("was"), F.col("size").alias("had"))
    both = listing.join(old, "file_path", "full_outer")
    status = (F.when(F.col("was").isNull(), "new").when(F.col("modified").isNull(), "removed")
              .when((F.col("modified") != F.col("was")) | (F.col("size") != F.col("had")), "changed").otherwise("same"))
    return with_path_keys(both.select("file_path", "modified", status.alias("status")))
