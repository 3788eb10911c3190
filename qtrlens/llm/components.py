"""Connected components by alternating star contractions (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links (u, v) with the smallest node of its component.

    Each round writes its links to the shared folder, and ends when a round changes nothing;
    the rounds grow with the logarithm of the longest path. Minima are pre-aggregated in each
    task, so a node with very many links is one row per task in that shuffle. No links: empty.
    """
    now = written(edges.select("u", "v"), "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(small.select("u", F.col("m").alias("v"))
                      .union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    least = now.groupBy("u").agg(F.min("v").alias("root"))
    return least.select(F.col("u").alias("node"), "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
