"""Best-fit packing by exact-complement hashing.

Only lengths matter for where pieces go, so the packing works on the counts of the at most
1024 lengths, whatever the corpus's size. Single lengths, pairs and triples are indexed by
their sums; from the longest on, the gap beside a length is looked up there and the
combination that fills it exactly is consumed as often as the counts allow; what has no
exact complement is filled best-fit. Each combination is a run of sequences; pieces of a
length take the runs' places by rank, which counts per task and a prefix sum give them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2


class SumIndex:
    """Available lengths, their pairs and their triples, each under its sum.

    A pair is filed under ``high + low``; a triple under ``top`` plus the sum of a pair of lengths
    no longer than ``top``, so three lengths take one entry per sum of the two shorter ones. The
    entries of a sum lie together, the longest first. Counts only fall: an entry at the head of
    its sum that has run out is passed for good. Memory is some eight bytes per pair of lengths
    that fit together (about 5 MB for 1,024 lengths), whatever the number of pieces."""

    def __init__(self, avail: np.ndarray):
        self.avail, self.capacity = avail, len(avail) - 1
        lengths = np.flatnonzero(avail)
        highs, lows = (lengths[x] for x in np.tril_indices(len(lengths)))
        self.pair, (self.high, self.low) = self._filed(highs + lows, highs, lows)
        sums = np.flatnonzero(np.diff(self.pair))
        least = np.full(self.capacity + 1, self.capacity + 1)  # the shortest high of each pair sum
        least[sums] = self.high[self.pair[sums + 1] - 1]
        tops, rests = (x.ravel() for x in np.meshgrid(lengths, sums, indexing="ij"))
        on = least[rests] <= tops
        self.triple, (self.top, self.rest) = self._filed((tops + rests)[on], tops[on], rests[on])
        self.pair_head, self.triple_head = self.pair[:-1].copy(), self.triple[:-1].copy()

    def _filed(self, sums: np.ndarray, longest: np.ndarray, other: np.ndarray):
        """Where each sum's entries begin, and the entries."""
        on = sums <= self.capacity
        sums, longest, other = sums[on], longest[on], other[on]
        order = np.lexsort((-longest, sums))
        begins = np.searchsorted(sums[order], np.arange(self.capacity + 2))
        return begins, (longest[order].astype(np.int32), other[order].astype(np.int32))

    def pair_of(self, total: int, spare: np.ndarray, top: int) -> tuple[int, int] | None:
        """Two lengths of that sum that ``spare`` holds, none above ``top``."""
        head, end = self.pair_head[total], self.pair[total + 1]
        while head < end and not (self.avail[self.high[head]] and self.avail[self.low[head]]):
            head += 1
        self.pair_head[total] = head
        high, low = self.high[head:end], self.low[head:end]
        ok = np.flatnonzero((high <= top) & (spare[high] > 0) & (spare[low] > (high == low)))
        return (int(high[ok[0]]), int(low[ok[0]])) if len(ok) else None

    def triple_of(self, total: int, spare: np.ndarray) -> tuple[int, int, int] | None:
        """Three lengths of that sum that ``spare`` holds."""
        head, end = self.triple_head[total], self.triple[total + 1]
        while head < end and not (self.avail[self.top[head]] and self.pair_head[self.rest[head]] < self.pair[self.rest[head] + 1]):
            head += 1
        self.triple_head[total] = head
        for k in head + np.flatnonzero(spare[self.top[head:end]] > 0):
            top, rest = int(self.top[k]), int(self.rest[k])
            spare[top] -= 1
            two = self.pair_of(rest, spare, top)
            spare[top] += 1
            if two:
                return (top, *two)
        return None

    def exact(self, gap: int, spare: np.ndarray, depth: int) -> tuple[int, ...] | None:
        """At most ``depth`` lengths that ``spare`` holds and that fill the gap exactly, the fewest first."""
        if spare[gap] > 0:
            return (gap,)
        found = self.pair_of(gap, spare, gap) if depth > 1 else None
        return found or (self.triple_of(gap, spare) if depth > 2 else None)


def _packed(counts: dict[int, int], capacity: int, depth: int) -> list[tuple[dict[int, int], int]]:
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        avail[length] = n
    sums, out = SumIndex(avail), []
    for length in range(capacity, 0, -1):
        while avail[length] > 0:
            combo, gap, spare = [], capacity, avail.copy()
            take = (length,)
            while take:
                for x in take:
                    spare[x] -= 1
                combo += take
                gap -= sum(take)
                take = sums.exact(gap, spare, depth) if gap else None
                if not take:  # no exact complement: the best fit, then its complement
                    fits = np.flatnonzero(spare[: gap + 1])
                    take = (int(fits[-1]),) if len(fits) else None
            need = Counter(combo)
            times = min(int(avail[x]) // k for x, k in need.items())
            for x, k in need.items():
                avail[x] -= k * times
            out.append((dict(need), times))
    return out


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths with how many of each, number of such sequences) that use up the counts. Triples
    fill more gaps at once but use up short pieces, so complements of up to three, two and one
    lengths are each tried, and the plan with the fewest sequences is taken."""
    plans = [_packed(counts, capacity, depth) for depth in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def places(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length, its runs in order of rank: (first rank, first sequence, offset, how many in each)."""
    runs: dict[int, list] = {}
    used, sequence = Counter(), 0
    for need, times in combinations(counts, capacity):
        offset = 0
        for length, k in sorted(need.items(), reverse=True):
            runs.setdefault(length, []).append((used[length], sequence, offset, k))
            used[length] += k * times
            offset += k * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length
    in its task (part, nth)."""

    def run(batches):
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), Counter(), Encoder()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        for b in batches:
            for lo, hi, ids, at in encoder.encode(b.column(1)):
                out, end = [], np.uint32(end_id).tobytes()
                raw = ids.astype("<u4", copy=False).tobytes()
                for i in range(hi - lo):
                    tokens = raw[4 * at[i] : 4 * at[i + 1]] + end
                    n = len(tokens) // 4
                    first = n % capacity or capacity
                    for k, stop in enumerate(range(first, n + 1, capacity)):
                        start = max(0, stop - capacity) if k else 0
                        out.append((lo + i, k, start, stop - start, crc32(tokens[4 * start : 4 * stop]), part, seen[stop - start]))
                        seen[stop - start] += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=names)

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part long, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null or empty text is one piece, the end id alone. Repeated rows are packed separately; an
    empty table gives an empty result. Other columns are not read. Only the counts of the
    lengths reach the driver; no length's pieces meet in one task."""
    cut = written(pieces(docs, capacity, end_id), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    runs = places({int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                on, mine = np.flatnonzero(length == x), runs[int(x)]
                r = mine[np.searchsorted(mine[:, 0], rank[on], "right") - 1]
                nth = rank[on] - r[:, 0]
                sequence[on], offset[on] = r[:, 1] + nth // r[:, 3], r[:, 2] + nth % r[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, kind)
