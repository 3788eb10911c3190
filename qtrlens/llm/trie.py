"""Prefix trie of conversations, as tables of nodes indexed by minimal perfect hashes.

A node is a distinct sequence of first turns. Its key is a 128-bit digest, the XOR of digests
of its turns at their places, so it is had by running sums; equal keys are checked to have equal
last turns (SHA-256) and parents, which by induction makes them the same sequence.

A shard holds the conversations of one hash value, cut into bands of depths so that neither many
conversations nor a long one fill it. It enumerates its distinct keys, gives each a slot by a
minimal perfect hash (the slot holds the key, so a wrong slot is seen), scatters counts into flat
arrays, and sums subtrees through the array of parent slots, deepest first. A node met in many
shards has a part in each; parts are added up by key. What a subtree has in deeper bands comes
in as a sum per conversation at the band's last node.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textscan import mixed

#: Depths in a band; rows in a shard, about.
BAND, SHARD_ROWS = 1_024, 2_048
#: Turns that a rebuilt conversation can take from another.
MAX_SHARED = 8
#: Characters of a piece of joined ids.
PIECE = 1 << 16

_KEY = ["hi", "lo"]
#: What a conversation has below a band: bytes of its turns, bytes and leaves of the nodes it owns.
_DEEP = ["deep_all", "deep_owned", "deep_leaves"]
_PART = ("shard int, slot int, parent_slot int, depth long, hi long, lo long, parent_hi long, parent_lo long, c0 long, c1 long, "
         "bytes long, n long, first long, inner boolean")


class NodeTable:
    """A minimal perfect hash of distinct 128-bit keys, which the slots hold.

    Level by level, keys that are alone at their hash get that place; the others go on to the next
    level. A slot is the rank of the place among all places taken."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels, at, base = [], np.arange(len(hi)), 0
        place = np.zeros(len(hi), np.int64)
        while len(at):
            size = 2 * len(at) + 1
            h = self._hash(hi[at], lo[at], len(self.levels), size)
            alone = np.bincount(h, minlength=size) == 1
            self.levels.append((size, base, np.cumsum(alone) - alone, alone))
            fits = alone[h]
            place[at[fits]] = base + (np.cumsum(alone) - alone)[h[fits]]
            base, at = base + int(alone.sum()), at[~fits]
            if len(self.levels) > 200:
                raise ValueError("the keys are not distinct")
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[place], self.lo[place] = hi, lo

    @staticmethod
    def _hash(hi, lo, level, size):
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
        return (mixed(hi.astype(np.uint64) ^ mixed(lo.astype(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for keys that are not in the table."""
        out, at = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (size, base, rank, alone) in enumerate(self.levels):
            h = self._hash(hi[at], lo[at], level, size)
            hit = alone[h]
            out[at[hit]] = base + rank[h[hit]]
            at = at[~hit]
        wrong = (out >= 0) & ((self.hi[out] != hi) | (self.lo[out] != lo))
        out[wrong] = -1
        return out


def up(depth: np.ndarray, parent: np.ndarray, *sums: np.ndarray) -> None:
    """Add each slot's sums to its parent's, from the deepest slots on (parent -1: none)."""
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.r_[True, depth[order][1:] != depth[order][:-1], True])
    for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
        at = order[a:b]
        at = at[parent[at] >= 0]
        for s in sums:
            np.add.at(s, parent[at], s[at])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, c, bytes): turns numbered from 0 by turn (null first) within their conversation,
    ties by content, each with 128 bits of the SHA-256 of role and text.

    Rows are dealt by ranges of (conversation, turn), so a conversation may span partitions; those
    after its first add what the earlier ones have of it (at most one row per partition)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = written(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("c"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "trie-turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "c", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "c", "bytes")

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            i = np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))
            if conv[0] == last:
                i[: first[1] if len(first) > 1 else len(conv)] += n
            last, n = conv[-1], i[-1] + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(i), b.column(1), b.column(2)], names=["conv_id", "part", "i", "c", "bytes"])

    rows = written(rows.mapInArrow(count, "conv_id long, part int, i long, c binary, bytes long"), "trie-numbered")
    have = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = have.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")  # one conversation a partition
    return rows.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "c", "bytes")


def rebuilt(turns: DataFrame, shared=None, base=None) -> DataFrame:
    """(conv_id, pos, c, bytes, len): the first ``shared`` turns of conversation ``base``, then the
    conversation's own turns after its first ``shared``; ``len`` is how many there are. Every
    conversation also has a row with pos -1, so that one without turns is there too."""
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("n")).select("conv_id", (F.col("n") + 1).alias("n"))
    convs = convs.withColumn("h", shared if shared is not None else F.lit(0)).withColumn("base", base if base is not None else F.col("conv_id"))
    bases = convs.select(F.col("conv_id").alias("base"), F.least(F.col("n"), F.lit(MAX_SHARED + 1)).alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "k", "n", "len"), "trie-conversations")
    # a long conversation's turns meet its row in as many groups as it has bands
    bands = convs.withColumn("band", F.explode(F.expr(f"sequence(0L, (n - 1) div {BAND})")))
    own = turns.withColumn("band", F.expr(f"i div {BAND}")).join(bands, ["conv_id", "band"]).where("i >= h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "c", "bytes", "len")
    heads = turns.where(F.col("i") < MAX_SHARED).select(F.col("conv_id").alias("base"), F.col("i").alias("pos"), "c", "bytes")
    taken = convs.where("k > 0").select("conv_id", "base", "k", "len").join(heads, "base").where("pos < k").select("conv_id", "pos", "c", "bytes", "len")
    top = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(b"").alias("c"), F.lit(0).cast("long").alias("bytes"), "len")
    return own.unionByName(taken).unionByName(top)


def _parts(rows: DataFrame, shards: int, band: int) -> DataFrame:
    """Of every shard: its nodes (kind 0), and for each conversation its last node in each band
    (kind 1; ``last``: it ends there)."""
    at = F.greatest(F.col("pos"), F.lit(0))
    rows = rows.withColumn("band", F.floor(at / band))
    # what a prefix adds up
    rows = rows.withColumn("a", F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(3), "pos", "c")))
    rows = rows.withColumn("b", F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(4), "c", "pos")))
    rows = rows.select("conv_id", "band", "pos", "c", "bytes", "len", "a", "b")
    # long conversations: what the earlier bands add up to, as a row before the band's first
    sums = rows.where(F.col("len") > band).groupBy("conv_id", "band").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    upto = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "band", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b")).where("band > 0")
    carried = sums.select("conv_id", "band", F.lit(-2).cast("long").alias("pos"), F.lit(b"").alias("c"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("len"), "a", "b")
    dealt = rows.unionByName(carried).withColumn("shard", F.pmod(F.xxhash64("conv_id", "band"), F.lit(shards)).cast("int"))
    kind = f"kind int, conv_id long, band long, last boolean, {_PART}"

    def nodes(group):
        import pyarrow as pa

        col = lambda name: group.column(name).to_numpy()
        order = np.lexsort((col("pos"), col("band"), col("conv_id")))
        conv, bands, pos, size, length = (col(x)[order] for x in ("conv_id", "band", "pos", "bytes", "len"))
        a, b = (np.bitwise_xor.accumulate(col(x)[order]) for x in ("a", "b"))
        c = group.column("c").combine_chunks().take(pa.array(order))
        both = np.zeros((len(conv), 2), np.int64)
        real = pos >= 0
        both[real] = np.frombuffer(b"".join(c.filter(pa.array(real)).to_pylist()), np.int64).reshape(-1, 2)
        head = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (bands[1:] != bands[:-1])])
        group_of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(conv)]))
        before = lambda x: np.r_[0, x][head][group_of]  # noqa: E731  what the groups before have added up
        hi, lo = a ^ before(a), b ^ before(b)
        prev = np.r_[-1, np.arange(len(conv) - 1)]
        parent_hi, parent_lo = np.where(real, hi[prev], 0), np.where(real, lo[prev], 0)
        tail = np.r_[head[1:], len(conv)] - 1  # of each conversation's band
        keep = np.flatnonzero(pos > -2)
        depth = pos + 1
        _, one = np.unique(np.stack([hi[keep], lo[keep]]), axis=1, return_index=True)
        one = keep[one]
        table = NodeTable(hi[one], lo[one])
        slot = table.slots(hi, lo)
        n = len(one)
        made = slot[one]
        if len(np.unique(made)) != n or (made < 0).any():
            raise ValueError("slots are not one to one")
        rep = np.empty(n, np.int64)
        rep[made] = one
        for x in (depth, parent_hi, parent_lo, both[:, 0], both[:, 1]):
            if (x[keep] != x[rep][slot[keep]]).any():
                raise ValueError("two prefixes have one digest")
        count, first, inner = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
        np.add.at(count, slot[keep], 1)
        np.minimum.at(first, slot[keep], conv[keep])
        np.logical_or.at(inner, slot[keep], depth[keep] < length[keep])
        parent = table.slots(parent_hi[rep], parent_lo[rep])
        parent[depth[rep] == 0] = -1
        parent[(depth[rep] > 1) & ((depth[rep] - 1) % band == 0)] = -1  # of another band, so another shard's work
        shard = int(group.column("shard")[0].as_py())
        ends = len(tail)
        z = np.zeros(n, np.int64)
        top = {"kind": np.r_[z, np.ones(ends, np.int64)].astype(np.int32), "conv_id": np.r_[z, conv[tail]], "band": np.r_[z, bands[tail]],
               "last": np.r_[np.zeros(n, bool), depth[tail] == length[tail]], "shard": np.full(n + ends, shard, np.int32),
               "slot": np.r_[np.arange(n), slot[tail]].astype(np.int32), "parent_slot": np.r_[parent, np.full(ends, -1)].astype(np.int32)}
        for name, x in (("depth", depth), ("hi", hi), ("lo", lo), ("parent_hi", parent_hi), ("parent_lo", parent_lo), ("c0", both[:, 0]), ("c1", both[:, 1]), ("bytes", size)):
            top[name] = np.r_[x[rep], x[tail]]
        top |= {"n": np.r_[count, z[:0], np.zeros(ends, np.int64)], "first": np.r_[first, conv[tail]], "inner": np.r_[inner, np.zeros(ends, bool)]}
        return pa.table(top)

    return written(dealt.groupBy("shard").applyInArrow(nodes, kind), "trie-parts")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the joined ids of the conversations that end at each node.

    Ids are joined where ranges of (node, id) put them; what a range has of its first and its last
    node may go on in a neighbour, so it is passed on as pieces of joined text."""
    order = [*_KEY, "conv_id"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "hi long, lo long, from long, piece string, done string"

    def join(batches):
        import hashlib

        import pyarrow as pa

        seen, key, ids, start, size = 0, None, [], 0, 0
        out = []

        def flush(whole):
            text = ",".join(ids)
            out.append((*key, start, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None))

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["hi", "lo", "from", "piece", "done"])

        cut = False
        for b in batches:
            for hi, lo, conv in zip(*(b.column(k).to_pylist() for k in range(3))):
                if key != (hi, lo):
                    if key is not None:
                        flush(seen > 1 and not cut)
                    seen, key, ids, start, size, cut = seen + 1, (hi, lo), [], conv, 0, False
                elif size > PIECE:
                    flush(False)
                    ids, start, size, cut = [], conv, 0, True
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) > 10_000:
                yield batch()
        if key is not None:
            flush(False)
        if out:
            yield batch()

    got = written(ranged.mapInArrow(join, kind), "trie-ends")
    pieces = got.where("done is null").select(*_KEY, "from", "piece").repartition(*_KEY).sortWithinPartitions(*_KEY, "from")

    def finish(batches):
        import hashlib

        import pyarrow as pa

        key, h, out = None, None, []
        for b in batches:
            for hi, lo, _, piece in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key != (hi, lo):
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (hi, lo), hashlib.sha256(piece.encode())
                else:
                    h.update(f",{piece}".encode())
        if key is not None:
            out.append((*key, h.hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["hi", "lo", "ends_sha256"])

    whole = got.where("done is not null").select(*_KEY, F.col("done").alias("ends_sha256"))
    return whole.unionByName(pieces.mapInArrow(finish, "hi long, lo long, ends_sha256 string"))


def trie(rows: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of ``rows`` (as ``rebuilt`` gives them), with what a subtree sums to."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    parts = _parts(rows, shards, band)
    nodes, tails = parts.where("kind = 0"), parts.where("kind = 1")
    # a node has at most one part a shard; the part with its smallest member is its own
    same = ["depth", "parent_hi", "parent_lo", "c0", "c1"]
    alike = F.lit(True)
    for x in same:
        alike = alike & (F.min(x) == F.max(x))
    owners = written(nodes.groupBy(*_KEY).agg(F.min("first").alias("node_first"), F.sum("n").alias("n_convs"), F.max("inner").alias("node_inner"), F.count("*").alias("parts"), alike.alias("alike")), "trie-owners")
    # nodes with over a thousandth of all parts (the root, first turns of many) are fewer than a thousand
    total = nodes.count()
    common = F.broadcast(owners.where(F.col("parts") * 1_000 > total).select(*_KEY, "node_first", "n_convs", "node_inner", "alike"))
    rare = owners.where(F.col("parts") * 1_000 <= total).drop("parts")
    nodes = nodes.join(common, _KEY).unionByName(nodes.join(common, _KEY, "left_anti").join(rare, _KEY))
    own = F.when(F.col("alike"), F.col("first") == F.col("node_first")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("boolean"))
    nodes = written(nodes.withColumn("own", own).select(
        "shard", "slot", "parent_slot", "depth", *_KEY, "parent_hi", "parent_lo", "bytes", "n", "node_first", "n_convs", "own", (~F.col("node_inner")).alias("leaf")), "trie-nodes")

    # what a conversation has in deeper bands goes to its last node in each band
    deeper = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    owned = nodes.where(F.col("own") & (F.col("depth") > band)).groupBy(F.col("node_first").alias("conv_id"), F.floor((F.col("depth") - 1) / band).alias("band")).agg(
        F.sum("bytes").alias("deep_owned"), F.sum(F.col("leaf").cast("long")).alias("deep_leaves"))
    member = rows.where((F.col("len") > band) & (F.col("pos") >= 0)).groupBy("conv_id", F.floor(F.col("pos") / band).alias("band")).agg(F.sum("bytes").alias("deep_all"))
    tot = member.join(owned, ["conv_id", "band"], "left").select("conv_id", "band", *[F.sum(F.coalesce(x, F.lit(0))).over(deeper).alias(x) for x in _DEEP]).where("deep_all is not null")
    carry = tot.join(tails.select("conv_id", "band", "shard", "slot"), ["conv_id", "band"]).select("shard", "slot", *_DEEP)
    fields = ["parent_slot", "depth", *_KEY, "parent_hi", "parent_lo", "bytes", "n", "node_first", "n_convs", "own", "leaf"]
    mine = nodes.select("shard", "slot", *fields, *[F.lit(None).cast("long").alias(x) for x in _DEEP])
    carry = carry.select("shard", "slot", *[F.lit(None).cast(nodes.schema[x].dataType).alias(x) for x in fields], *_DEEP)
    kind = "hi long, lo long, conv_id long, depth long, parent_hi long, parent_lo long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"

    def sums(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        more = group.filter(pc.is_valid(group.column("deep_all")))
        group = group.filter(pc.is_null(group.column("deep_all"))).sort_by("slot")
        g = {x: group.column(x).to_numpy() for x in ("slot", *fields)}
        n = len(g["slot"])
        if (g["slot"] != np.arange(n)).any():
            raise ValueError("a shard's slots are not complete")
        own, parent = g["own"].astype(bool), g["parent_slot"].astype(np.int64)
        saved, leaves = g["n"] * g["bytes"] - own * g["bytes"], (own & g["leaf"].astype(bool)).astype(np.int64)
        at = more.column("slot").to_numpy()
        np.add.at(saved, at, more.column("deep_all").to_numpy() - more.column("deep_owned").to_numpy())
        np.add.at(leaves, at, more.column("deep_leaves").to_numpy())
        up(g["depth"], parent, saved, leaves)
        children = np.zeros(n, np.int64)
        np.add.at(children, parent[own & (parent >= 0)], 1)
        above = np.where(parent >= 0, g["node_first"][parent], -1)
        hide = lambda x, off: pa.array(x, pa.int64(), mask=off)
        out = {x: pa.array(g[x]) for x in _KEY} | {"conv_id": hide(g["node_first"], ~own), "depth": hide(g["depth"], ~own), "parent_hi": hide(g["parent_hi"], ~own | (parent >= 0)),
               "parent_lo": hide(g["parent_lo"], ~own | (parent >= 0)), "parent_conv_id": hide(above, ~own | (parent < 0)), "n_convs": hide(g["n_convs"], ~own),
               "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved)}
        out = pa.table(out)
        # the parents of a band's first nodes are in other shards
        far = np.flatnonzero(own & (parent < 0) & (g["depth"] > 0))
        if len(far):
            none = pa.nulls(len(far), pa.int64())
            zero = pa.array(np.zeros(len(far), np.int64))
            plus = [pa.array(g["parent_hi"][far]), pa.array(g["parent_lo"][far]), none, none, none, none, none, none, pa.array(np.ones(len(far), np.int64)), zero, zero]
            out = pa.concat_tables([out, pa.table(plus, names=out.column_names)])
        return out

    summed = mine.unionByName(carry).groupBy("shard").applyInArrow(sums, kind)
    hashes = _end_hashes(tails.where("last"))
    values = [x.split()[0] for x in kind.split(", ")[2:]]
    blank = F.lit(None).cast("long")
    hashes = hashes.select(*_KEY, *[blank.alias(x) for x in values], "ends_sha256")
    both = summed.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(hashes)
    total = {"n_children", "n_leaves", "saved_tokens"}
    out = both.groupBy(*_KEY).agg(*[(F.sum(x) if x in total else F.max(x)).alias(x) for x in values], F.max("ends_sha256").alias("ends_sha256"))
    far = nodes.where(F.col("own") & (F.col("depth") % band == 0) & (F.col("depth") > 0)).select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("node_first").alias("far"))
    out = written(out, "trie")
    # only first nodes of a band look their parent up
    near, deep = out.where("depth = 0 or parent_conv_id is not null"), out.where("depth > 0 and parent_conv_id is null")
    deep = deep.join(far, ["parent_hi", "parent_lo"]).withColumn("parent_conv_id", F.col("far")).drop("far")
    empty = F.sha2(F.lit(""), 256)
    return near.unionByName(deep.select(*near.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shared=None, base=None, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per node of the conversations' prefix trie: conv_id (smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens (bytes of texts that
    the subtree's nodes hold for more than one conversation) and ends_sha256.

    ``shared`` and ``base`` (columns of conv_id; at most 8 and any id) rebuild each conversation as
    the first turns of another and its own after as many; an absent one gives none. Turns go by
    turn (null first), ties by their contents' hash, so repeated rows are turns of their own in any
    case. Null role or text is empty; rows without conv_id belong to no conversation and take no
    part; an empty table gives no nodes; texts of any length count whole; other columns are not
    read."""
    return trie(written(rebuilt(numbered(conversations), shared, base), "trie-rebuilt"), band, shard_rows)


def rebuilt_trie(conversations: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of conversations that share up to eight first turns with that of the next lower id
    divisible by five."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    return prefix_trie(conversations, h, F.col("conv_id") - F.col("conv_id") % 5, band, shard_rows)
