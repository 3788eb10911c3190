"""Sinks: write the tables, keep them in step with a tree of files, load all nine with a report.

Writes are idempotent: Parquet partitioned by ``year`` with dynamic partition
overwrite, so re-running a load replaces the years it touches instead of appending
duplicates. ``sync_table`` merges by file, with a manifest. The row count of a write comes from an ``Observation`` on the same write job (no
second pass over the data).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qtrlens.schemas import TIERS

log = logging.getLogger(__name__)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = "year") -> int:
    """Write ``df`` as Parquet; returns the number of rows written.

    ``mode="overwrite"`` replaces only the partitions present in ``df`` (dynamic
    partition overwrite); ``mode="append"`` adds rows, as the source's loader did.
    """
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    rows = int(obs.get.get("rows", 0) or 0)
    if rows == 0:
        log.warning("write_table: no rows for %s", path)
    return rows


FILE_KEY = ["state", "year", "quarter"]


@dataclass(frozen=True)
class Merged:
    """What a merge did: files read, rows they gave, files it could not use, files gone since."""
    files: int = 0
    rows: int = 0
    quarantined: int = 0
    removed: int = 0


def sync_table(spark: SparkSession, root: str, table: str, out_dir: str, everything: bool = False,
               arrived: DataFrame | None = None) -> Merged:
    """Make ``out_dir/<table>`` what a fresh load of the files under ``root`` would make it.

    The listing is compared with the table's manifest (``sources.manifest``). Files that are new or
    changed are read, once; ``everything`` takes all files for changed. The rows of a state, year
    and quarter are replaced by those of all its present files as soon as one of them is new,
    changed or removed, so files that lost their entries or are gone leave no rows. Only the years
    concerned are written; a year without rows left is deleted. A file of zero bytes is no file
    (Spark does not list it). Files that cannot be used keep their text in the manifest, and in
    ``_quarantine/<table>``, until they are mended. A change that leaves a file's time and size as
    they were is seen by a load only.

    ``arrived`` (with file_path) limits the work to the quarters of these files. The manifest is
    written last: a run that is cut off is repeated by the next one, with the same result. Two
    runs on one folder at a time are not supported.
    """
    from qtrlens.session import ensure_checkpoint_dir
    from qtrlens.sources import manifest as M
    from qtrlens.sources.ingest import CORRUPT, FLATTEN, _exists, empty_table, list_files, quarantined, read_payloads, rows_of, with_path_keys
    ensure_checkpoint_dir(spark)
    base = out_dir.rstrip("/")
    path = f"{base}/{table}"
    listing = list_files(spark, root, table)
    if listing is None:
        listing = spark.createDataFrame([], "file_path string, modified timestamp, size bigint")
    known = M.read_manifest(spark, base, table)
    plan = M.compared(listing, known)
    if everything:
        plan = plan.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
    if arrived is not None:
        quarters = with_path_keys(arrived.select("file_path").distinct()).select(*FILE_KEY).distinct()
        named = plan.join(quarters, [plan[k].eqNullSafe(quarters[k]) for k in FILE_KEY], "left_semi")
        plan = named.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
    plan = plan.checkpoint()
    touched = plan.where("status != 'same'")
    counts = {r["status"]: r for r in touched.groupBy("status").agg(F.count("*").alias("n"), F.min("modified").alias("since")).collect()}
    stored = _exists(spark, path)
    if not counts:
        if not stored:
            write_table(empty_table(spark, table), path)
        return Merged()

    # every present file of a quarter of which a file is touched; a path without a quarter for itself
    keys = touched.where("quarter is not null").select(*FILE_KEY).distinct()
    present = plan.where("status != 'removed'")
    present = present.join(keys, FILE_KEY, "left_semi").unionByName(present.where("quarter is null and status != 'same'"))
    since = present.agg(F.min("modified")).first()[0]
    if since is None:
        parsed = None
    else:
        parsed = read_payloads(spark, root, table, since).join(present.select("file_path"), "file_path", "left_semi").checkpoint()
    new = rows_of(parsed, table) if parsed is not None else empty_table(spark, table)

    # the table's years that hold such quarters (on a full load, all)
    years = keys.select("year").distinct()
    if stored:
        old = read_table(spark, path, table)
        kept = old.join(years, "year", "left_semi").join(keys, FILE_KEY, "left_anti") if not everything else old.where("false")
        merged = kept.select(*new.columns).unionByName(new).checkpoint()
        was = old.select("year").distinct() if everything else old.join(years, "year", "left_semi").select("year").distinct()
        gone = [r[0] for r in was.join(merged.select("year").distinct(), "year", "left_anti").collect()]
    else:
        merged, gone = new, []
    write_table(merged, path)
    for year in gone:
        M.delete_folder(spark, f"{path}/year={year}")

    # the manifest: what was read as it was read, the rest as it was known
    entries = known.join(plan.where("status = 'removed'").select("file_path"), "file_path", "left_anti").withColumn("fresh", F.lit(False))
    if parsed is not None:
        # flatteners pass the state through, so the path in its place counts rows by file
        by_file = (FLATTEN[table](parsed.where(F.col(CORRUPT).isNull()).withColumn("state", F.col("file_path")))
                   .groupBy(F.col("state").alias("file_path")).agg(F.count("*").alias("rows")))
        read = parsed.join(by_file, "file_path", "left").join(quarantined(parsed), "file_path", "left").select(
            "file_path", "modified", "size", "hash", *FILE_KEY, F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), "raw", "partly_read",
            F.lit(True).alias("fresh"))
        entries = entries.join(parsed.select("file_path"), "file_path", "left_anti").select(*read.columns).unionByName(read)
    entries = entries.checkpoint()
    M.write_manifest(entries.drop("fresh"), base, table)
    got = entries.agg(F.count_if("fresh").alias("files"), F.sum(F.when(F.col("fresh"), F.col("rows"))).alias("rows"),
                      F.count_if(F.col("fresh") & F.col("raw").isNotNull()).alias("broken"), F.count("raw").alias("bad")).first()
    if got.bad or _exists(spark, f"{base}/_quarantine/{table}"):
        entries.where("raw is not null").select("file_path", "raw", "partly_read").write.mode("overwrite").parquet(f"{base}/_quarantine/{table}")
    return Merged(got.files, got.rows or 0, got.broken, counts["removed"]["n"] if "removed" in counts else 0)


def run_jobs(jobs: dict[str, "callable"], parallel: int = 1) -> dict[str, tuple[int | None, str | None]]:
    """Run independent Spark write jobs, ``parallel`` at a time (driver threads submit
    jobs; no data passes through the driver). A failing job does not stop the others."""
    def one(name, fn):
        try:
            return name, (fn(), None)
        except Exception as e:  # noqa: BLE001 - reported, the other jobs still run
            log.error("%s failed: %s", name, e)
            return name, (None, f"{type(e).__name__}: {e}"[:500])
    if parallel <= 1:
        return dict(one(n, f) for n, f in jobs.items())
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return dict(pool.map(lambda kv: one(*kv), jobs.items()))


def load_all(spark: SparkSession, root: str, out_dir: str, tables: list[str] | None = None,
             parallel: int = 1) -> DataFrame:
    """Ingest every table of the JSON tree into ``out_dir/<table>``, tier by tier
    (``parallel`` > 1 runs that many table loads concurrently).

    A failing table does not stop the others; the report has one row per table: ``(tier, table,
    rows, error, files, quarantined, removed)``; files = those loaded + those quarantined, removed
    = those of the last load or refresh that are gone. Loading again gives the same tables.
    """
    tier_of = {n: t for t, names in TIERS.items() for n in names}
    jobs = {n: (lambda n=n: sync_table(spark, root, n, out_dir, everything=True))
            for n in tier_of if not tables or n in tables}
    done = run_jobs(jobs, parallel)
    report = [(tier_of[n], n, got and got.rows, error, got and got.files, got and got.quarantined, got and got.removed)
              for n, (got, error) in done.items()]
    return spark.createDataFrame(report, "tier string, table string, rows bigint, error string, files bigint, quarantined bigint, removed bigint")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a written table back with its declared schema (year from the partition)."""
    from qtrlens.schemas import TABLE_SCHEMAS
    from qtrlens.sources.ingest import conform
    return conform(spark.read.schema(TABLE_SCHEMAS[table]).parquet(path), table)


NATURAL_KEYS = {
    "aggregated_transaction": ["state", "year", "quarter", "transaction_type"],
    "aggregated_insurance": ["state", "year", "quarter"],
    "map_transaction": ["state", "district", "year", "quarter"],
    "map_insurance": ["state", "district", "year", "quarter"],
}


def natural_key_totals(df: DataFrame, table: str) -> DataFrame:
    """The dashboard's table loaders: sum the measures per natural key (S13, S15).

    On a table loaded more than once by appending (the source's H24) this adds the
    copies up, exactly as the source's loaders do; with idempotent writes it is a
    no-op reshaping. Partial aggregation keeps the shuffle to one row per key per task.
    """
    from qtrlens.schemas import TABLE_SCHEMAS
    keys = NATURAL_KEYS[table]
    measures = [f.name for f in TABLE_SCHEMAS[table].fields if f.name not in keys]
    out = df.groupBy(*keys).agg(*[F.sum(m).cast(TABLE_SCHEMAS[table][m].dataType).alias(m) for m in measures])
    return out.select(*[f.name for f in TABLE_SCHEMAS[table].fields])
