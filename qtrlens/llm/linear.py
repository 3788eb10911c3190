"""Hashed linear text scorers: word and character n-gram shares, logistic regression, calibration.

A text's features are the shares of its words in each word slot and of its byte 4-grams in
each gram slot, so a score is a mean of slot weights and whole batches are scored at once.
Training reads a bounded sample in one task; scoring runs in Arrow batches everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import SpanHash, chunks, per_text, words

SLOT_BITS = 15
#: Rows of the training sample, the bound on what one task reads.
SAMPLE_ROWS = 2000
STEPS = 150
RIDGE = 1e-4


def slots(data, off, hasher):
    """(word slots, first word of each text, gram slots, first gram of each text)."""
    starts, ends, first = words(data, off)
    word = (hasher.of(data, starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    n_grams = np.maximum(np.diff(off) - 3, 0)
    begin = np.concatenate([[0], np.cumsum(n_grams)])
    if not begin[-1]:
        return word, first, np.zeros(0, np.int32), begin
    d = data.astype(np.uint32)
    gram = ((d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
    inside = np.ones(len(gram), bool)
    for k in range(1, 4):  # grams that would reach into the next text
        cut = off[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(gram))]] = False
    gram = gram[inside].astype(np.int32)
    return word, first, gram, begin


def raw_scores(data, off, hasher, model) -> np.ndarray:
    """Bias plus the mean weight of the words and that of the grams (of none: 0)."""
    word, first, gram, begin = slots(data, off, hasher)
    return (model["bias"] + per_text(model["word"][word], first) / np.maximum(np.diff(first), 1)
            + per_text(model["gram"][gram], begin) / np.maximum(np.diff(begin), 1))


def probability(raw: np.ndarray, model) -> np.ndarray:
    """Calibrated probability of the good class."""
    a, b = model["platt"]
    return 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))


def _features(texts):
    """Rows of (slot, share), gram slots after the word slots."""
    hasher, out = SpanHash(), []
    for _, _, data, off in chunks(texts):
        word, first, gram, begin = slots(data, off, hasher)
        for i in range(len(off) - 1):
            ids, weights = [], []
            for base, part in ((0, word[first[i] : first[i + 1]]), (1 << SLOT_BITS, gram[begin[i] : begin[i + 1]])):
                s, c = np.unique(part, return_counts=True)
                ids.append(s + base)
                weights.append(c / max(len(part), 1))
            out.append((np.concatenate(ids), np.concatenate(weights)))
    return out


def _fit(rows, y, steps=STEPS, ridge=RIDGE):
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient
    descent with the step that the data's largest eigenvalue allows."""
    dim = 2 << SLOT_BITS
    col = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    dot = lambda w: np.bincount(row, val * w[col], len(rows))
    back = lambda g: np.bincount(col, val * g[row], dim)
    v = np.ones(dim) / np.sqrt(dim)
    for _ in range(8):
        v = back(dot(v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * (top / len(rows) * 1.1) + ridge * 0.01 + 1e-12)
    w = z = np.zeros(dim)
    b = zb = 0.0
    for k in range(1, steps + 1):
        g = 1 / (1 + np.exp(-np.clip(dot(z) + zb, -40, 40))) - y
        w2 = z - step * (back(g) / len(rows) + ridge * 0.01 * z)
        b2 = zb - 2 * g.mean()
        z, zb = w2 + (k - 1) / (k + 2) * (w2 - w), b2 + (k - 1) / (k + 2) * (b2 - b)
        w, b = w2, b2
    return w, b


def _platt(raw, y):
    """Slope and shift that fit the labels' probabilities to held-out scores (Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        q = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * raw).sum() + 1e-3 * (a - 1), (p - y).sum()])
        hess = np.array([[(q * raw * raw).sum() + 1e-3, (q * raw).sum()], [(q * raw).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, grad)
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def fit_texts(texts, y: np.ndarray) -> dict | None:
    """A calibrated model of texts (Arrow column) and labels in 0..1; None unless both
    classes have four rows. Calibration uses scores of models that haven't seen the row."""
    if min((y >= 0.5).sum(), (y < 0.5).sum()) < 4:
        return None
    rows = _features(texts)
    fold = np.arange(len(rows)) % 2
    held = np.zeros(len(rows))
    for f in (0, 1):
        w, b = _fit([r for r, k in zip(rows, fold) if k != f], y[fold != f], STEPS // 2)
        for i in np.flatnonzero(fold == f):
            held[i] = b + (w[rows[i][0]] * rows[i][1]).sum()
    w, b = _fit(rows, y)
    n = 1 << SLOT_BITS
    return {"word": w[:n], "gram": w[n:], "bias": b, "platt": _platt(held, y)}


def train(sample: DataFrame, label: str = "label", text: str = "text", rows: int = SAMPLE_ROWS) -> dict | None:
    """The model of at most ``rows`` rows of the sample, those with the smallest hashes, so
    reruns agree; it is fitted in one task and comes back as 0.5 MB of weights."""
    key = F.xxhash64(F.lit(7), F.coalesce(F.col(text), F.lit("")))
    picked = sample.select(F.col(label).cast("double").alias("y"), F.col(text).alias("x"), key.alias("k")).filter("y is not null")
    picked = picked.orderBy("k", "y").limit(rows).repartition(1).sortWithinPartitions("k", "y")

    def run(batches):
        import pickle

        import pyarrow as pa

        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        model = fit_texts(table.column("x"), table.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    import pickle

    found = picked.mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else None
