"""Session helpers.

Library functions never create a session; they take DataFrames. These helpers are
for tests, the bench and command-line use. On a cluster the session comes from the
platform and already names ``spark.checkpoint.dir``; we only fill it in when unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes, coalesces
# small shuffle partitions and splits skewed ones; the UI server stays off.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "qtrlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used inside the library)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="qtrlens-warehouse-"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("QTRLENS_DRIVER_MEM", "8g")))
    for k, v in {**_DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Spark reads it by. A folder named without one is in the session's
    default file system, which need not be the local disk that plain file calls would use."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is set by
    the platform; we read it and never override it (and refuse to invent one). Only a
    local-mode session without the setting (tests, the bench) gets a fresh folder.
    """
    context = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if named and not current:
        context.setCheckpointDir(named)
    if named or current:
        return named or current
    if not (context.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                           "(a machine-local folder does not survive executor loss)")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="qtrlens-ckpt-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, with its scheme."""
    return f"{qualified(spark, ensure_checkpoint_dir(spark)).rstrip('/')}/qtrlens/{name}-{uuid.uuid4().hex}"
