"""Intermediate tables and binary files in the folder all executors share.

A written table cuts the lineage: an executor lost later costs a reread, not a
recomputation. Only committed task output is ever read. Folders carry a random id, so
runs don't meet; ``purge`` removes what a session has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qtrlens.session import scratch_path

_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    path = scratch_path(spark, name)  # with its scheme: tasks that open files need Spark's file system, not their own
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the folders this process has written; results that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(conf).delete(p, True)


def file_system(path: str):
    """(file system, path in it) for a folder inside a task: any scheme that pyarrow opens
    (file, hdfs, s3, gs, abfs); a path without a scheme is a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
