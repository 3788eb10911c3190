"""Incremental ingest with Structured Streaming.

The source's refresh re-pulls every file and appends everything again. Here a file
stream over the JSON tree, run with ``trigger(availableNow=True)``, names the files not seen
by earlier runs (the checkpoint remembers their paths; contents are not read by the stream).
Each batch is merged by ``sinks.sync_table`` for the quarters of its files, the same way as a
full load, so all can share a folder and a batch that is run again after a lost driver changes
nothing. A file stream never looks at a path again; files that changed in place or
are gone show in the table's manifest, and ``refresh`` merges those too.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from qtrlens.session import ensure_checkpoint_dir
from qtrlens.sinks import Merged, sync_table
from qtrlens.sources.ingest import SOURCES, _exists

#: Schema of Spark's binary file source; only the paths are read.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_table(spark: SparkSession, root: str, table: str, out_dir: str,
                 checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                 done: list[Merged] | None = None) -> StreamingQuery:
    """Start an availableNow stream that merges new files' rows into ``table``; ``done`` gets what
    every batch did."""
    reader = (spark.readStream.schema(_FILES).format("binaryFile")
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(SOURCES[table].base(root)).select(F.col("_metadata.file_path").alias("file_path"))
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest/{table}"

    def merge(batch, _):
        got = sync_table(batch.sparkSession, root, table, out_dir, arrived=batch)
        if done is not None:
            done.append(got)

    return (files.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


def refresh(spark: SparkSession, root: str, out_dir: str, tables: list[str] | None = None,
            checkpoint_base: str | None = None, max_files_per_trigger: int | None = None) -> dict[str, int]:
    """Bring the tables in step with the files; rows loaded per table.

    New, changed and removed files are found by the manifest. With ``checkpoint_base``, new files
    come by the stream first, ``max_files_per_trigger`` at a time."""
    added: dict[str, int] = {}
    for table in tables or list(SOURCES):
        done: list[Merged] = []
        if checkpoint_base and _exists(spark, SOURCES[table].base(root)):
            stream_table(spark, root, table, out_dir, f"{checkpoint_base.rstrip('/')}/{table}", max_files_per_trigger, done).awaitTermination()
        done.append(sync_table(spark, root, table, out_dir))
        added[table] = sum(m.rows for m in done)
    return added
