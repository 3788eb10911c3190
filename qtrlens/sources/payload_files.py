"""Writing payloads as the tree of small JSON files that the ingest reads.

One file per state and quarter, as ``.../state/<slug>/<year>/<quarter>.json``. The top tier
lists places, and pincodes have no bound: a quarter with more than ``PLACES_PER_FILE`` of
them goes to numbered parts (``1.json``, ``1.1.json``, ...), so no list grows with the data.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtrlens.sources.payloads import payloads, top_payload_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

PLACES_PER_FILE = 1_000


def file_system(path: str):
    """(file system, path in it) for a path inside a task: any scheme that pyarrow opens (file, hdfs,
    s3, gs, abfs); a path without a scheme is a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_files(files: DataFrame) -> tuple[int, int]:
    """Write ``(file_path, json)`` rows as files; returns (files, bytes).

    A file appears whole: it is written under another name and then moved, so a task
    that is run again, or twice at a time, leaves the same files."""

    def write(batches):
        import uuid

        import pyarrow as pa

        made: set[str] = set()
        for b in batches:
            sizes = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = file_system(path)
                folder = at.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{at}.{uuid.uuid4().hex}"
                data = text.encode()
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, at)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["size"])

    done = files.select("file_path", "json").mapInArrow(write, "size long")
    got = done.agg(F.count("*"), F.sum("size")).first()
    return int(got[0]), int(got[1] or 0)


def remove_files(files: DataFrame) -> int:
    """Delete the files at ``file_path``, where there are any still; returns how many rows asked for it."""

    def remove(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                if fs.get_file_info(at).is_file:  # a task that is run again finds them gone
                    fs.delete_file(at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return int(files.select("file_path").mapInArrow(remove, "n long").agg(F.sum("n")).first()[0] or 0)


def payload_files(df: DataFrame, table: str, root: str, places_per_file: int = PLACES_PER_FILE) -> DataFrame:
    """``(file_path, json)`` of a table's rows under ``root``."""
    made = top_payload_parts(df, table, places_per_file, root) if table.startswith("top_") else payloads(df, table, root=root)
    return made.select("file_path", "json")
