"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: several learned rotations (iterative quantisation on a bounded
sample), one bit per rotated component. Codes are split into bytes, and each byte position is
an index from its 256 values to the rows that have one near it. By the pigeonhole principle a
code within radius r of the query has a byte position within its share of r, so the union of
the probed entries holds every code within r; those are kept and reranked with the original
vectors. Rows lie in blocks of bounded size, and the query set meets them block by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Vectors on which rotations and radius are fitted, queries among them, and rotations.
FIT_ROWS, FIT_QUERIES, ROTATIONS = 3000, 300, 4
#: Share of the sample's true neighbours that the radius must hold.
HOLD = 0.97
#: Rows in a block of the index, about, and queries in a block of the query set.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def codes_of(x: np.ndarray, model: dict) -> np.ndarray:
    """One row of code bytes per vector."""
    centred = x - model["mean"]
    return np.concatenate([np.packbits(centred @ r > 0, axis=1) for r in model["rotations"]], 1)


def fitted(x: np.ndarray, k: int, seed: int = 9) -> dict:
    """Rotations by iterative quantisation from seeded starts, and the radius that holds ``HOLD``
    of the true neighbours in the sample (whose neighbours are farther than those in all rows)."""
    rng, mean = np.random.default_rng(seed), x.mean(0)
    centred, rotations = x - mean, []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(15):
            u, _, v = np.linalg.svd(centred.T @ np.where(centred @ r > 0, 1.0, -1.0))
            r = u @ v
        rotations.append(r)
    model = {"mean": mean, "rotations": rotations}
    code, q = codes_of(x, model), min(FIT_QUERIES, len(x))
    score = x[:q] @ x.T
    score[np.arange(q), np.arange(q)] = -np.inf
    near = np.argsort(-score, 1)[:, : max(1, min(k, len(x) - 1))]
    far = np.bitwise_count(code[:q, None] ^ code[near]).sum(2)
    return model | {"radius": int(np.quantile(far, HOLD))}


def usable(rows: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and has no null or non-finite component."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


class Index:
    """A block's codes by byte position: for each of the 256 values a bitmap of the rows within
    the position's share of the radius."""

    def __init__(self, code: np.ndarray, radius: int):
        n, m = code.shape
        self.code, self.radius, self.n = np.ascontiguousarray(code), radius, n
        share = [radius // m - (j > radius % m) for j in range(m)]  # the first radius % m + 1 positions have one more
        gap = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])
        self.maps = []
        for j in range(m):
            values, inverse = np.unique(code[:, j], return_inverse=True)
            near = gap[:, values] <= share[j]
            self.maps.append(np.packbits(near[:, inverse], axis=1))

    def within(self, q: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius: probe, unite, verify."""
        probed = self.maps[0][q[0]].copy()
        for maps, value in zip(self.maps[1:], q[1:]):
            probed |= maps[value]
        rows = np.flatnonzero(np.unpackbits(probed, count=self.n))
        return rows[np.bitwise_count(self.code[rows] ^ q).sum(1) <= self.radius]


def block_best(query_ids, queries, ids, vectors, model, k: int):
    """(query row, id, score) of each query's k best rows of a block (ties to the smaller id)."""
    index, probe, out = Index(codes_of(vectors, model), model["radius"]), codes_of(queries, model), []
    for i, q in enumerate(queries):
        rows = index.within(probe[i])
        rows = rows[ids[rows] != query_ids[i]]
        if not len(rows):
            continue
        score = vectors[rows] @ q
        if len(rows) > k:
            rows = rows[score >= np.partition(score, len(rows) - k)[len(rows) - k] - 1e-9]
        score = (vectors[rows] * q).sum(1)  # the same sum for equal vectors, so ties are ties
        best = np.lexsort((ids[rows], -score))[:k]
        out += [(i, int(ids[rows[b]]), float(score[b])) for b in best]
    return out


def neighbours(rows: DataFrame, is_query, k: int = 20, vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found of every query (``is_query``,
    a condition on vec_id), by inner product in double precision; ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor rows
    without vec_id. Vectors of one length are searched among themselves (there is no inner
    product of others); each length has an index of its own. Rows with the query's own
    vec_id aren't its candidates; other repeated rows each count; repeated queries are one. A
    query with fewer than k candidates in the radius gets the nearest of all rows. An empty
    table gives an empty result. Other columns are not read."""
    kind = f"query_id {dict(rows.dtypes)['vec_id']}, rank int, vec_id {dict(rows.dtypes)['vec_id']}, score double"
    fine = usable(rows.select("vec_id", F.col(vec).cast("array<double>").alias("v")).filter("vec_id is not null"), "v")
    found = rows.sparkSession.createDataFrame([], kind)
    for dim, n in fine.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        found = found.unionByName(_of_length(fine.filter(F.size("v") == dim), dim, n, is_query, k, block_rows))
    return found


def _of_length(fine: DataFrame, dim: int, n: int, is_query, k: int, block_rows: int) -> DataFrame:
    """The neighbours among ``n`` usable vectors of ``dim`` components."""
    blocks = max(1, -(-n // block_rows))
    stored = written(fine.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "vectors")
    # written first: a collected limit would send every task's own top rows to the driver
    sample = written(stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v"), "ann-sample")
    sample = np.array([r.v for r in sample.collect()])
    model = fitted(sample, k)
    asked = stored.filter(is_query).select("vec_id", "v").distinct()
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // (20 * QUERY_ROWS))))).cast("int"))
    # answers carry the query's number, not its vector (one vec_id may have several vectors)
    asked = written(asked.withColumn("qid", F.monotonically_increasing_id()), "ann-queries")
    chunks = [r[0] for r in asked.select("chunk").distinct().collect()]
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = stored.withColumn("chunk", F.explode(F.array(*[F.lit(c).cast("int") for c in chunks]) if chunks else F.array().cast("array<int>")))

    def as_matrix(column) -> np.ndarray:
        import pyarrow as pa

        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten()).reshape(-1, dim)

    def search(model):
        def run(queries, block):
            import pyarrow as pa

            query_ids, qid, ids = (x.to_numpy() for x in (queries.column("vec_id"), queries.column("qid"), block.column("vec_id")))
            found = block_best(query_ids, as_matrix(queries.column("v")), ids, as_matrix(block.column("v")), model, k) if len(ids) and len(qid) else []
            cols = list(zip(*found)) or [(), (), ()]
            at = np.array(cols[0], np.int64)
            return pa.table({"query_id": pa.array(query_ids[at]), "qid": pa.array(qid[at]), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})
        return run

    def best(queries, model):
        met = queries.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search(model), "query_id long, qid long, vec_id long, score double")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = written(best(left, model), "ann-near")
    full = near.filter(F.col("rank") == k).select("qid")
    if full.count() == asked.count():
        return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    short = left.join(full, "qid", "left_anti")  # too few codes in the radius: all rows
    rest = best(short, model | {"radius": 8 * dim * ROTATIONS})
    both = near.join(full, "qid", "left_semi").unionByName(rest)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
