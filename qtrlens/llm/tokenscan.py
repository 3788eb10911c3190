"""Token counts of flat token files by separator scan.

A token file is nothing but 16-bit ids, each document ended by a separator id; it has no
index. Files are scanned in blocks: a vectorised search finds a block's separators, and a
prefix scan over the blocks' summaries (separators so far, last separator so far) joins the
documents that cross block bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import file_system, new_path, written
from .tokens import Encoder

SEPARATOR = 50256
#: Tokens in a block, and bytes of a file after which a task starts another.
BLOCK_TOKENS, FILE_BYTES = 2 << 20, 256 << 20


def write_tokens(docs: DataFrame, folder: str, separator: int = SEPARATOR) -> DataFrame:
    """Tokenise every document into flat files; returns which document is which of each committed
    file's (path, ordinal, doc_id). A text that spells the separator gets ordinary ids."""

    def write(batches):
        import uuid

        import pyarrow as pa

        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        encoder, out, path, n, size = Encoder(), None, "", 0, 0
        encoder.whole.encode_special_tokens = True
        for b in batches:
            for lo, hi, ids, at in encoder.encode(b.column(1)):
                flat = np.insert(ids, at[1:], separator).astype("<u2")
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.u16", 0, 0
                    out = fs.open_output_stream(f"{top}/{path.rpartition('/')[2]}")
                out.write(flat.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([path] * (hi - lo)), pa.array(np.arange(n, n + hi - lo)), b.column(0).slice(lo, hi - lo)], names=["path", "ordinal", "doc_id"])
                n, size = n + hi - lo, size + flat.nbytes
                if size > FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    kind = f"path string, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}"
    return written(docs.select("doc_id", "text").mapInArrow(write, kind), "token-order")


def separators(flat: np.ndarray, begin: int, total: int, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ends before them) of a block's separators; the one before the first is unknown
    (-2). The file's end is one too if no separator stands there."""
    at = np.flatnonzero(flat == separator) + begin
    if begin + len(flat) == total and (not len(flat) or flat[-1] != separator):
        at = np.append(at, total)
    return at, np.concatenate([[-2], at[:-1]])[: len(at)]


def scan(spark: SparkSession, paths: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, start and n_tokens (without the separator) of every document of the files
    in ``paths`` (path). Ids after the last separator are a document; an empty file has none;
    two separators in a row enclose an empty document."""

    def blocks(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                total = fs.get_file_info(at).size // 2
                out += [(path, k, total) for k in range(-(-total // block_tokens))]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "block", "total"])

    def find(batches):
        import pyarrow as pa

        for b in batches:
            for path, k, total in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    raw = f.read_at(2 * min(block_tokens, total - k * block_tokens), 2 * k * block_tokens)
                at, before = separators(np.frombuffer(raw, "<u2"), k * block_tokens, total, separator)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(np.full(len(at), k)), pa.array(np.arange(len(at))), pa.array(at), pa.array(before)],
                                                 names=["path", "block", "nth", "at", "before"])

    listed = paths.select("path").distinct().mapInArrow(blocks, "path string, block long, total long")
    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    found = written(listed.repartition(tasks, "path", "block").mapInArrow(find, "path string, block long, nth long, at long, before long"), "separators")
    summary = found.groupBy("path", "block").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last_before"))
    start = F.when(F.col("nth") == 0, F.col("last_before")).otherwise(F.col("before")) + 1
    return found.join(prefix, ["path", "block"]).select("path", (F.col("n_before") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """doc_id and n_tokens of every document: written to flat files in the shared folder and
    counted there by the scan alone. Null and empty texts have no tokens; repeated rows are
    counted separately; an empty table gives an empty result. Other columns are not read."""
    order = write_tokens(docs, new_path(docs.sparkSession, "tokens"), separator)
    found = scan(docs.sparkSession, order.select("path"), separator)
    return order.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")
