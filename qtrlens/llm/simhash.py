"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text's word shingles vote on the 64 bits of its fingerprint. Every pair of
fingerprints within the radius r must share a bucket: the bits are dealt out over the
non-zero vectors of F_2^(r+1), and table v keeps the bits whose vector has an odd product
with v. Any r vectors leave some v orthogonal to all of them, so in table v none of the
differing bits is kept and the pair collides (2^(r+1) - 1 tables, no misses).

The distinct fingerprints of a bucket are verified inside it: each is compared with the few
others there, and only true links leave. A bucket with more than ``MOST`` values is never
turned into pairs: its values are tested, as exactly, by their midpoints. Two fingerprints
differ in at most r bits exactly if some 64-bit word lies within r/2 bits of both, so each
emits the words around it, and those that meet at a word are linked to the smallest of them
(at most 65 meet for r = 2). Copies of a text are one value, however many they are.
Components come from alternating star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import roots
from .store import written
from .textscan import LOWER, chunks, words

BITS = 64
#: Distinct fingerprints that are compared inside one bucket; fuller buckets are tested by midpoints.
MOST = 32
#: A fingerprint is hot if more than one in so many rows has it.
HOT_SHARE = 1000


def shingle_hashes(data, off, size: int):
    """(hashes, counts): XXH64 (seed 42) of each text's lower-cased, space-joined shingles,
    all texts in a row, and how many each text has. Fewer words than ``size``: one shingle
    of the whole sequence; no words: none."""
    from xxhash import xxh64_intdigest as xxh

    starts, ends, first = words(data, off)
    n_words = np.diff(first)
    keep = np.zeros(len(data), bool)
    if len(data):
        from .textscan import WHITE

        keep = ~WHITE[data]
    joint = np.ones(len(starts), bool)  # all words but the first of each text have one space before them
    joint[first[:-1][n_words > 0]] = False
    flat = LOWER[data]
    gap = starts[joint] - 1
    keep[gap], flat[gap] = True, 0x20
    moved = np.cumsum(keep) - keep
    text = flat[keep].tobytes()
    starts, ends = moved[starts], moved[ends - 1] + 1
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    last = np.minimum(at + size, np.repeat(first[1:], counts)) - 1
    hashes = np.fromiter((xxh(text[a:b], 42) for a, b in zip(starts[at].tolist(), ends[last].tolist())), np.uint64, len(at))
    return hashes, counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the 64 bits set in over half of its hashes (none: zero). Four counters of
    16 bits share one word, so runs of at most 65,535 hashes are added at a time."""
    votes = np.zeros((len(counts), BITS), np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    run = 65535
    runs = -(-counts // run)
    owner = np.repeat(np.arange(len(counts)), runs)
    if len(owner):
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        cut = begin[owner] + nth * run
        lanes, low = np.uint64(0x0001000100010001), np.uint64(0xFFFF)
        for k in range(16):
            part = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cut)
            for lane in range(4):
                np.add.at(votes[:, k + 16 * lane], owner, ((part >> np.uint64(16 * lane)) & low).astype(np.int64))
    set_bits = votes * 2 > counts[:, None]
    return (set_bits.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle_words: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp`` (long): the fingerprint of each row's whole text."""
    out = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [np.zeros(0, np.uint64)]
            for _, _, data, off in chunks(b.column(len(keep))):
                fps.append(majority(*shingle_hashes(data, off, shingle_words)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.concatenate(fps).view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed 64-bit masks."""
    space = 1 << (radius + 1)
    vector = [1 + i % (space - 1) for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, space)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints ``fp`` within ``radius``
    bits of each other: all links found in buckets of at most ``most`` values, chains of true
    links through the values of fuller ones."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: values of full buckets meet at midpoints")
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))])).alias("b"))
    keyed = keyed.select("fp", "b.t", "b.k")
    crowded = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(keyed.join(crowded, ["t", "k"]), "simhash-buckets")
    few = buckets.filter(F.col("n") <= most).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    near = lambda a, b: (b < a) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
    true = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    verified = few.select(F.explode(true).alias("link")).select("link.u", "link.v")
    members = buckets.filter(F.col("n") > most).select("fp").distinct()
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    flips = [signed(sum(1 << i for i in c)) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    around = members.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("z"))
    meet = around.withColumn("v", F.min("fp").over(Window.partitionBy("z")))
    return verified.union(meet.filter("fp <> v").select(F.col("fp").alias("u"), "v")).distinct()


def grouped(docs: DataFrame, text: str, keep: tuple[str, ...], order: str, shingle_words: int, radius: int) -> DataFrame:
    """``keep``, ``fp``, ``root`` (the component's smallest fingerprint) and ``component_id``."""
    prints = written(fingerprints(docs, text, keep, shingle_words), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min(order).alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    root = written(roots(links(nodes, radius)), "simhash-roots")
    linked = nodes.join(root.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    far = linked.join(least, "root").select("fp", "root", "least_id")
    label = written(nodes.join(far, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id"), "n"), "simhash-labels")
    # fingerprints of over a thousandth of the rows are fewer than a thousand: they are broadcast, the rest shuffled
    total = label.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(label.filter(F.col("n") * HOT_SHARE > total).drop("n"))
    cold = label.filter(F.col("n") * HOT_SHARE <= total).drop("n")
    out = [*keep, "fp", "root", "component_id"]
    return prints.join(hot, "fp").select(*out).unionAll(prints.join(hot, "fp", "left_anti").join(cold, "fp").select(*out))


def near_duplicates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: str = "doc_id",
                    shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``keep``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest ``order`` value that links of at most ``radius`` bits reach (its own included;
    null only if all of them are null).

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    are rows of the same component. An empty table gives an empty result. Only fingerprints
    are shuffled, never texts; copies of a text meet as one row per task. Other columns of
    ``docs`` are not read.
    """
    found = grouped(docs, text, keep, order, shingle_words, radius)
    return found.select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest doc_id stays (null ids last; then by text hash; of repeated rows one), with all
    its columns."""
    cols = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("doc_id").alias("__id"),
                        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__hash"),
                        F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    found = grouped(keyed, "__text", ("__id", "__hash"), "__id", shingle_words, radius)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__hash")).alias("best")).select(
        F.col("best.__id").alias("keep_id"), F.col("best.__hash").alias("keep_hash"))
    nth = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.xxhash64("__row")))
    single = keyed.select("__row", "__id", "__hash").withColumn("__nth", nth).filter("__nth = 1")
    kept = single.join(best, F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__hash") == F.col("keep_hash")), "left_semi")
    return kept.select("__row.*")
