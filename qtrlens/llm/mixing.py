"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt out in blocks of equal numbers of words: blocks go to sources by the highest
quotients target / (2k + 1), and each source's blocks to its shards by the same rule on the
shards' sizes. Each (source, shard) cell lays its documents on a line in seeded order and
takes its quota of blocks from a seeded block on, going around as often as needed.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textscan import chunks, mixed as hashed, words

SEED = 20
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_PASSES = 3
#: Rows in a cell, about (a source has as many shards as its rows need); blocks in the mix, at
#: least, and in each source's target for each of its cells.
SHARD_ROWS, BLOCKS, BLOCKS_PER_CELL = 2_000, 1 << 17, 256
#: Sources are a dimension of the mix; more than this is taken for a wrong column.
MAX_SOURCES = 100_000

N_WORDS = r"regexp_count(coalesce(`{}`, ''), '[^\\x20\\x09-\\x0D]+')"


def targets(sizes: list[int], weights: list[int], passes: int = MAX_PASSES) -> list[Fraction]:
    """What each source gives: shares of all words by weight, none above ``passes`` times its
    size; what goes over that is shared out again by weight among the others."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > passes * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(passes * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        open_ -= over
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), ties to the first.

    A quotient is a seat if it is at least some bar. Halving finds two neighbouring bars, one
    with too many seats; the few quotients between them are handed out from the highest."""
    weights = np.asarray(weights, float)
    if not len(weights) or weights.sum() <= 0 or seats <= 0:
        return np.zeros(len(weights), np.int64)

    def seated(bar):  # how many of each weight's quotients are at least the bar
        n = np.maximum(np.floor((weights / bar + 1) / 2).astype(np.int64), 0)
        n -= (n > 0) & (weights / np.maximum(2 * n - 1, 1) < bar)
        return n + (weights / (2 * n + 1) >= bar)

    high, low = np.nextafter(weights.max(), np.inf), weights.sum() / (2 * seats + 2 * len(weights))
    while True:  # the bar ``high`` gives at most the seats, ``low`` at least as many
        bar = (high + low) / 2
        if not low < bar < high:
            break
        n = seated(bar).sum()
        if n == seats:
            return seated(bar)
        high, low = (bar, low) if n < seats else (high, bar)
    out = seated(high)
    last = np.flatnonzero(seated(low) > out)  # equal quotients, of the first weights first
    out[last[: seats - out.sum()]] += 1
    return out


def _planned(sized: DataFrame, seed: int, weights: tuple[int, ...]):
    """From (source, key, size): sources (source, rank, source_size, target, shards) and quotas (rank,
    shard, cell_size, take, start)."""
    got = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got = sorted(((r.source, int(r.words), -(-r.n // SHARD_ROWS)) for r in got), key=lambda x: (x[0] is None, x[0] or ""))
    aim = targets([x[1] for x in got], [weights[i % len(weights)] for i in range(len(got))])
    total = sum(x[1] for x in got)
    # no source's target is so few blocks that rounding to whole ones would miss it
    block = max(1, min([total // BLOCKS, *(a // (BLOCKS_PER_CELL * x[2]) for a, x in zip(aim, got) if a > 0)]))
    seats = [int(x) for x in sainte_lague([float(x) for x in aim], total // block)]
    kind = f"source {dict(sized.dtypes)['source']}, rank int, source_size long, target double, seats long, shards int"
    sources = sized.sparkSession.createDataFrame([(s, i, size, float(aim[i]), seats[i], shards) for i, (s, size, shards) in enumerate(got)], kind)

    def deal(cells):
        cells = cells.sort_values("shard")
        q = sainte_lague(cells["cell_size"].to_numpy(), int(cells["seats"].iloc[0]))
        size = cells["cell_size"].to_numpy().astype(np.int64)
        cells["take"] = np.minimum(q * block, MAX_PASSES * size)
        blocks = np.maximum(size // block, 1)
        drawn = hashed(hashed(cells["shard"].to_numpy().astype(np.uint64) + np.uint64(seed)) + cells["rank"].to_numpy().astype(np.uint64))
        cells["start"] = (drawn % blocks.astype(np.uint64)).astype(np.int64) * block
        return cells[["rank", "shard", "cell_size", "take", "start"]]

    ranked = _sharded(sized, sources, seed).groupBy("rank", "__shard").agg(F.sum("size").alias("cell_size"), F.first("seats").alias("seats"))
    quotas = ranked.withColumnRenamed("__shard", "shard").groupBy("rank").applyInPandas(deal, "rank int, shard int, cell_size long, take long, start long")
    return sources, quotas


def _sharded(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` with what ``sources`` says of their source, and their shard (__shard)."""
    named = F.broadcast(sources.withColumnRenamed("source", "__s"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return rows.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "key"), "shards").cast("int"))


def _taken(rows: DataFrame, sources: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with source, key, size) plus source_size, target and where the mix goes over them:
    ``passes`` times whole, and words ``a1``..``b1`` and ``a2``..``b2`` once more."""
    rows = _sharded(rows, sources, seed)
    rows = rows.join(quotas.withColumnRenamed("rank", "__r"), (F.col("rank") == F.col("__r")) & (F.col("__shard") == F.col("shard")))
    line = Window.partitionBy("__r", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum("size").over(line) - F.col("size")
    rows = rows.withColumn("__at", at)
    rows = rows.withColumn("passes", F.expr("cast(case when cell_size = 0 then 0 else take div cell_size end as int)"))
    rows = rows.withColumn("__rest", F.expr("take - passes * cell_size"))
    for k, shift in ((1, "0"), (2, "cell_size")):  # from the start on, and around the end of the line
        rows = rows.withColumn(f"a{k}", F.expr(f"least(size, greatest(0, start - {shift} - __at))"))
        rows = rows.withColumn(f"b{k}", F.expr(f"greatest(a{k}, least(size, start + __rest - {shift} - __at))"))
    return rows.withColumn("taken", F.expr("passes * size + (b1 - a1) + (b2 - a2)"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of each document).

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, the
    last; repeated rows are taken separately, in an order in which equal rows are alike. An
    empty table gives an empty result. Other columns are not read. Reruns agree."""
    sized = written(docs.select("doc_id", "source", F.expr(N_WORDS.format("text")).cast("long").alias("size"),
                                F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("key")), "mix")
    sources, quotas = _planned(sized, seed, weights)
    return _taken(sized, sources, quotas, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass over a document and
    one for each part of it that is taken once more (its text cut at words, n_chars with it)."""
    key = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
    size = F.expr(N_WORDS.format("text")).cast("long")
    sized = written(docs.select("source", size.alias("size"), key.alias("key")), "mix")
    sources, quotas = _planned(sized, seed, weights)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size.alias("size"), key.alias("key"))
    cuts = _taken(rows, sources, quotas, seed).select(
        "row", F.explode(F.expr("filter(concat(transform(array_repeat(0, passes), x -> struct(0L as a, size as b)), "
                                "array(struct(a1 as a, b1 as b), struct(a2 as a, b2 as b))), x -> x.b > x.a)")).alias("cut"), "size")
    names = docs.columns
    own = [F.col("row").getField(c).alias(f"column{i}") for i, c in enumerate(names)]  # by place: any name may be taken
    whole = cuts.select(*own, F.col("cut.a").alias("cut_a"), F.col("cut.b").alias("cut_b"), "size")
    at, long_ = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            a, e, n = (b.column(len(names) + k).to_numpy() for k in range(3))
            cut = np.flatnonzero((a > 0) | (e < n))
            cols = [b.column(i) for i in range(len(names))]
            if len(cut):
                text, chars = cols[at].to_pylist(), cols[long_].to_pylist() if long_ is not None else None
                row = 0
                for lo, hi, data, off in chunks(cols[at].take(pa.array(cut))):
                    starts, ends, first = words(data, off)
                    for k in range(hi - lo):
                        i = cut[row]
                        row += 1
                        text[i] = data[starts[first[k] + a[i]] : ends[first[k] + e[i] - 1]].tobytes().decode()
                        if chars is not None:
                            chars[i] = len(text[i])
                cols[at] = pa.array(text, cols[at].type)
                if chars is not None:
                    cols[long_] = pa.array(chars, cols[long_].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return whole.mapInArrow(run, docs.schema)
