"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default ceiling for an explicit broadcast; Spark's own auto threshold is 10 MB.
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate of ``df`` (after pruning), or None if unavailable."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return size if isinstance(size, int) else int(size.toString())
    except Exception:  # Spark Connect or an unexpected plan: no estimate
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is under ``max_bytes``.

    Above the bound (or without an estimate) the frame is returned as is and the join
    stays a shuffle join; AQE can still switch to broadcast from runtime sizes.
    """
    limit = DEFAULT_BROADCAST_BYTES if max_bytes is None else max_bytes
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df
