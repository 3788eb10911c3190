"""Periodic runs of words, found on a grammar of the texts.

Texts are taken in chunks. Re-Pair replaces pairs of neighbours that come at least twice by
new symbols, round after round; what is left of a text becomes a balanced tree. Every run lies
in a smallest node of its text's derivation tree and crosses that node's boundary, so each
symbol's boundary is searched once, in one place where the symbol stands; what it has is
shifted to all the places where the symbol was put in, and intervals of one period are merged
to the maximal ones. All comparisons are exact: hashes only rule texts out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import chunks, mixed, words

MIN_WORDS, MIN_EXPONENT = 12, 2
#: A run's words equal those one period later over half its length at least: so many in a row.
SEED = MIN_WORDS // 2
#: Pairs of places looked at together (bounds memory).
SLICE = 1 << 20


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of the keys (which are not negative)."""
    key = keys[0]
    for k in keys[1:]:
        key = np.unique(key, return_inverse=True)[1] if len(key) and key.max() > 2**31 else key
        key = key.astype(np.int64) * (int(k.max()) + 1 if len(k) else 1) + k
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _may_repeat(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts in which some SEED words in a row may come twice (a text without has no run)."""
    n, doc = len(ids), np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = np.zeros(len(off) - 1, bool)
    if n < 2 * SEED:
        return out
    v = mixed(ids.astype(np.uint64) + np.uint64(1))
    odd = np.random.default_rng(7).integers(0, 2**62, SEED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = sum(v[j : n - SEED + 1 + j] * odd[j] for j in range(SEED))
    at = np.flatnonzero(doc[: n - SEED + 1] == doc[SEED - 1 :])
    h = h[at] ^ mixed(doc[at].astype(np.uint64))
    order = np.argsort(h)
    out[doc[at[order[1:][h[order[1:]] == h[order[:-1]]]]]] = True
    return out


class _Words:
    """Word ids of the texts of a chunk, with numbers of their 2^k-grams for exact comparisons."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        self.n, self.doc = len(ids), np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.end = off[1:][self.doc]
        self.grams, step = [ids], 1
        at = np.arange(self.n)
        while True:
            last = self.grams[-1]
            at = at[at + 2 * step <= self.end[at]]
            nums = _numbered(last[at], last[at + step]) if len(at) else at
            # longer grams only where this one comes again: no others can be equal further on
            again = np.bincount(nums)[nums] > 1 if len(at) else np.zeros(0, bool)
            if not again.any():
                break
            gram = np.full(self.n, -1)
            gram[at[again]] = nums[again]
            self.grams.append(gram)
            at, step = at[again], 2 * step
            at = at[(at + step < self.n) & (gram[np.minimum(at + step, self.n - 1)] >= 0)]

    def _equal(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        g = self.grams[k]
        return (g[x] >= 0) & (g[x] == g[y])

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on (x < y), ``most`` at most."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            live = np.flatnonzero(out + (1 << k) <= most)
            while len(live):
                live = live[self._equal(k, x[live] + out[live], y[live] + out[live])]
                out[live] += 1 << k
                live = live[out[live] + (1 << k) <= most[live]]
        return out

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words up to x and up to y."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            step = 1 << k
            live = np.flatnonzero(out + step <= most)
            while len(live):
                live = live[self._equal(k, x[live] - out[live] - step + 1, y[live] - out[live] - step + 1)]
                out[live] += step
                live = live[out[live] + step <= most[live]]
        return out

    def seeds(self):
        """(number, again): of the SEED-gram at each word within its text, -1 where none; whether
        the text has it more than once."""
        number, again = np.full(self.n, -1), np.zeros(self.n, bool)
        at = np.arange(self.n)
        at = at[at + SEED <= self.end[at]]
        if len(self.grams) > 2:
            g = self.grams[2]
            at = at[(g[at] >= 0) & (g[np.minimum(at + SEED - 4, self.n - 1)] >= 0)]
            if len(at):
                nums = _numbered(g[at], g[at + SEED - 4], self.doc[at])
                number[at], again[at] = nums, np.bincount(nums)[nums] > 1
        return number, again


def grammar(ids: np.ndarray, off: np.ndarray):
    """Nodes of a grammar of the texts, in lots: (start, boundary, end) of each node's first place,
    and the places (node in the lot, start) where it stands.

    A round replaces, of all pairs that come at least twice, those places at which no overlapping
    pair is more frequent. When no pair comes twice, neighbours are joined two by two."""
    sym, st = ids.astype(np.int64), np.arange(len(ids))
    en, doc = st + 1, np.repeat(np.arange(len(off) - 1), np.diff(off))
    fresh = int(sym.max(initial=0)) + 1

    def join(chosen, new):
        nonlocal sym, st, en, doc
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        sym[chosen], en[chosen] = new, en[chosen + 1]
        sym, st, en, doc = sym[keep], st[keep], en[keep], doc[keep]

    while len(sym) > 1:
        at = np.flatnonzero(doc[:-1] == doc[1:])
        if not len(at):
            return
        pairs, which, n = np.unique(sym[at] * fresh + sym[at + 1], return_inverse=True, return_counts=True)
        rank = np.zeros(len(pairs), np.int64)
        rank[np.lexsort((pairs, n))] = np.arange(1, len(pairs) + 1)
        rank[n < 2] = 0
        force = np.zeros(len(sym) + 1, np.int64)  # of the pair at i, at force[i + 1]
        force[at + 1] = rank[which]
        f = force[1:-1]
        if not f.any():
            break
        # stretches of one pair (x x x ...): every other place, if both neighbours are weaker
        first = np.flatnonzero((f > 0) & (f != force[:-2]))
        length = np.diff(np.r_[np.flatnonzero(np.r_[True, f[1:] != f[:-1]]), len(f)])
        length = length[f[np.flatnonzero(np.r_[True, f[1:] != f[:-1]])] > 0]
        strong = (force[first] < f[first]) & (force[first + length + 1] < f[first])
        first, length = first[strong], (length[strong] + 1) // 2
        chosen = np.repeat(first - 2 * (np.cumsum(length) - length), length) + 2 * np.arange(length.sum())
        _, place, node = np.unique(f[chosen], return_index=True, return_inverse=True)
        one = chosen[place]
        yield st[one], st[one + 1], en[one + 1], node, st[chosen]
        join(chosen, fresh + node)
        fresh += len(one)
    while len(sym) > 1:
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(sym)) - np.repeat(head, np.diff(np.r_[head, len(sym)]))
        chosen = np.flatnonzero((rank[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(chosen):
            return
        yield st[chosen], st[chosen + 1], en[chosen + 1], np.arange(len(chosen)), st[chosen]
        join(chosen, 0)


def _crossing(w: _Words, number, at_key, lo, mid, hi):
    """(node, start, end, period) of the runs across ``mid`` inside [lo, hi), not sure to be the
    smallest period. A run has SEED equal words in a row one period apart that start at most SEED
    words before the boundary, or end so near behind it: those give the periods to try."""
    n, found = w.n, []
    for j in range(-SEED, 1):
        s = mid + j
        ok = np.flatnonzero((s >= lo) & (s + SEED <= hi))
        ok = ok[number[s[ok]] >= 0]
        half = (hi - lo)[ok] // 2
        a = np.searchsorted(at_key, number[s[ok]] * n + np.maximum(lo[ok], s[ok] - half))
        b = np.searchsorted(at_key, number[s[ok]] * n + np.minimum(hi[ok] - SEED, s[ok] + half), "right")
        cnt = b - a
        node = np.repeat(ok, cnt)
        other = at_key[np.repeat(a - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())] % n
        q = np.abs(other - s[node])
        found.append((node * n + q)[q > 0])
    key = np.unique(np.concatenate(found))
    node, q = key // n, key % n
    out = []
    for x in (mid[node] - 1, mid[node] - q):  # a word that must equal the one a period later
        ok = np.flatnonzero((x >= lo[node]) & (x + q < hi[node]))
        i, p, x = node[ok], q[ok], x[ok]
        a = x + 1 - w.backward(x, x + p, x + 1 - lo[i])
        b = x + 1 + w.forward(x + 1, x + 1 + p, hi[i] - p - x - 1) + p
        ok = (a <= x) & (b - a >= np.maximum(MIN_WORDS, MIN_EXPONENT * p))
        out.append(np.stack([i[ok], a[ok], b[ok], p[ok]]))
    return np.unique(np.concatenate(out, 1), axis=1)


def find_runs(ids: np.ndarray, off: np.ndarray):
    """(text, start, length, period) of all runs, by text, start and period; starts count from the
    text's first word. ``off`` has the texts' first words, and the end."""
    may = _may_repeat(ids, off)
    texts, size = np.flatnonzero(may), np.diff(off)
    if not len(texts):
        return (np.zeros(0, np.int64),) * 4
    ids, off = ids[np.repeat(may, size)], np.r_[0, np.cumsum(size[may])]
    w = _Words(np.unique(ids, return_inverse=True)[1].astype(np.int64), off)
    number, again = w.seeds()
    number[~again] = -1
    key = np.sort(number[again] * w.n + np.flatnonzero(again))  # places by seed
    near = np.r_[0, np.cumsum(again)]
    got = [np.zeros((3, 0), np.int64)]
    for lo, mid, hi, node, at in grammar(w.grams[0], off):
        live = (hi - lo >= MIN_WORDS) & (near[mid + 1 - (mid == w.n)] > near[np.maximum(mid - SEED, lo)])
        use = np.flatnonzero(live)
        if not len(use):
            continue
        size = np.cumsum(hi[use] - lo[use])
        hits = [np.zeros((4, 0), np.int64)]
        for part in np.split(use, np.unique(np.searchsorted(size, np.arange(SLICE, size[-1], SLICE)))):
            if len(part):
                c = _crossing(w, number, key, lo[part], mid[part], hi[part])
                c[0] = part[c[0]]
                hits.append(c)
        hits = np.concatenate(hits, 1)
        if not hits.shape[1]:
            continue
        hits = hits[:, np.argsort(hits[0], kind="stable")]
        # every place of the node has its hits
        have = np.bincount(hits[0], minlength=len(lo))
        first = np.cumsum(have) - have
        at, node = at[have[node] > 0], node[have[node] > 0]
        cnt = have[node]
        h = hits[:, np.repeat(first[node] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())]
        shift = np.repeat(at - lo[node], cnt)
        got.append(np.stack([h[3], h[1] + shift, h[2] + shift]))
    p, a, b = np.concatenate(got, 1)
    d = w.doc[a] if len(a) else a
    order = np.lexsort((-b, a, p, d))
    p, a, b, d = p[order], a[order], b[order], d[order]
    # within a text and period only what no earlier interval holds; ends grow from group to group
    group = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]) if len(a) else a
    reach = np.maximum.accumulate(b + group * (w.n + 1)) if len(a) else a
    keep = np.r_[True, (b + group * (w.n + 1))[1:] > reach[:-1]] if len(a) else np.zeros(0, bool)
    p, a, b, d = p[keep], a[keep], b[keep], d[keep]
    order = np.lexsort((p, b, a))  # of one interval the smallest period
    p, a, b, d = p[order], a[order], b[order], d[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    p, a, b, d = p[keep], a[keep], b[keep], d[keep]
    order = np.lexsort((p, a))
    p, a, b, d = p[order], a[order], b[order], d[order]
    return texts[d], a - off[d], b - a, p


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, n_words, ``runs`` (start, length, period in words, by start and period)
    and ``collapsed``, the words without a run's repeats, joined by one space.

    A run is a stretch of at least 12 words and two periods, maximal for its smallest period; a
    word goes if any run has it after the run's first period. Null and empty texts have no words,
    no runs and an empty collapsed text; a null id stays null; repeated rows are answered
    separately; an empty table gives no rows; other columns are not read. A text is worked on
    whole, whatever its length, in memory of about 300 bytes a word; neighbouring texts are taken
    together up to 1 MB."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                starts, ends, first = words(data, off)
                inside = np.zeros(len(data) + 1, np.int8)
                inside[starts] = 1
                inside[ends] -= 1
                solid = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
                at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
                found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(solid))])
                ids = np.asarray(found.dictionary_encode().indices, np.int64) if len(starts) else np.zeros(0, np.int64)
                text, start, length, period = find_runs(ids, first)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, first[text] + start + period, 1)
                np.add.at(gone, first[text] + start + length, -1)
                keep = np.cumsum(gone[:-1]) == 0
                left = np.r_[0, np.cumsum(keep)][first].astype(np.int32)
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), found.filter(pa.array(keep, pa.bool_()))), " ")
                per = np.r_[0, np.cumsum(np.bincount(text, minlength=hi - lo))].astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per), each), collapsed],
                                                 names=[id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, kind)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by its id's CRC) gets a periodic tail: with h the
    unsigned crc32 of the decimal id, g = h div 10 and n words, each word i >= a = g % n becomes
    word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.expr(r"if(h % 10 = 0, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0), null)"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(size(w) > 0, cast(g % size(w) as int), null)"))
    rows = rows.withColumn("p", F.expr("1 + cast((size(w) - a) div (3 + g % 8) as int)"))
    tail = "concat_ws(' ', slice(w, 1, a), transform(sequence(0, size(w) - a - 1), k -> w[a + k % p]))"
    return rows.select("doc_id", F.expr(f"if(p is null, text, {tail})").alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: n_runs, its longest run (ties: smallest start, then period; none: nulls) and
    digests of all runs and of the collapsed text, of texts with planted tails."""
    found = periodic_runs(planted(docs))
    best = F.expr("array_sort(runs, (x, y) -> case when x.length != y.length then if(x.length > y.length, -1, 1) when x.start != y.start then if(x.start < y.start, -1, 1) else cast(sign(x.period - y.period) as int) end)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    got = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(best, 0).alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"),
                      F.expr("1000 * r.length div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
