"""Array kernels over the bytes of many texts at once (used inside Arrow batches).

A chunk is (data, off): the UTF-8 bytes of its texts one after another, and where each
text starts (one more entry than texts). Null texts count as empty.
"""

from __future__ import annotations

import numpy as np

#: Texts are taken in chunks of so many bytes (a longer text makes a chunk of its own).
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column, max_bytes: int = CHUNK_BYTES):
    """(first row, end row, data, off) for runs of rows of an Arrow string column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray):
    """(starts, ends, first): byte ranges of the runs without ASCII white space; the words
    of text i are first[i]..first[i+1]."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    return starts, ends, np.searchsorted(starts, off)


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the flags (or numbers) of each text."""
    total = np.zeros(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHash:
    """64-bit hashes of byte ranges, all from one running polynomial sum over the chunk."""

    def __init__(self, seed: int = 42):
        self.table = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, r = len(data), 0x9E3779B97F4A7C15
        if len(self.up) <= n:
            m = max(n + 1, CHUNK_BYTES + 1)
            powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(m - 1, base, np.uint64)], dtype=np.uint64)
            self.up, self.down = powers(r), powers(pow(r, -1, 1 << 64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal byte ranges, others for others (the bytes themselves are compared).
    The ranges don't overlap and are in order."""
    import pyarrow as pa

    if not len(starts):
        return np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    flat = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)])
    return np.asarray(spans.dictionary_encode().indices, np.int64)


def row_codes(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of the columns (numbers below 2^31), others for others."""
    import pyarrow as pa

    rows = np.ascontiguousarray(np.stack(columns, 1).astype(np.int32))
    if not len(rows):
        return np.zeros(0, np.int64)
    keys = pa.Array.from_buffers(pa.binary(4 * rows.shape[1]), len(rows), [None, pa.py_buffer(rows)])
    return np.asarray(keys.dictionary_encode().indices, np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(again, all_of_them): marks of the entries equal to an earlier one, and of every
    entry that has an equal."""
    again, both = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again[order[1:][same]] = True
    both[order[:-1][same]] = True
    return again, both | again
