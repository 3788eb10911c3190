"""Quality rules with a learned verdict: exact text statistics, and a hashed word and character
n-gram logistic regression trained on labelled rows, calibrated, scored in Arrow batches
against fixed thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE_ROWS, probability, raw_scores, train
from .store import written
from .textscan import WHITE, SpanHash, chunks, per_text, repeated, row_codes, span_codes, words

#: A text goes if its calibrated probability of good quality is below this.
KEEP_FROM = 0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(data, off) -> dict[str, np.ndarray]:
    """Per text of a chunk: words, code points in them, symbol characters, lines with a word
    that equal an earlier line, and words in 3-word windows that occur again in the text."""
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    starts, ends, first = words(data, off)
    n_words, n = np.diff(first), len(off) - 1
    out = {"n_words": n_words, "word_chars": per_text(~WHITE[data] & ((data & 0xC0) != 0x80), off),
           "n_symbols": per_text(symbol[data], off)}
    text_of = np.repeat(np.arange(n), n_words)
    # lines: from each text's start or line feed to the next
    feeds = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([off[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - ((data[end - 1] == 0x0A) & (end > begin)) if len(begin) else end
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    line_text = np.searchsorted(off, begin, "right") - 1
    again, _ = repeated(row_codes(line_text, span_codes(data, begin, end)))
    out["n_dup_lines"] = np.bincount(line_text, again, n).astype(np.int64)
    # windows of three words, none across texts
    h = span_codes(data, starts, ends)
    if len(h) > 2:
        inside = np.flatnonzero(text_of[:-2] == text_of[2:])
        _, twice = repeated(row_codes(text_of[inside], h[inside], h[inside + 1], h[inside + 2]))
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[inside[twice] + k] = True
        out["n_repeat_words"] = per_text(covered, first)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])


def judged(column, model) -> dict[str, np.ndarray]:
    """Statistics, ``base_failed``, ``quality`` (nan without a model) and ``kept`` of a column."""
    hasher, parts = SpanHash(), []
    for _, _, data, off in chunks(column):
        s = statistics(data, off)
        s["base_failed"] = base_failed(s)
        s["quality"] = probability(raw_scores(data, off, hasher, model), model) if model else np.full(len(off) - 1, np.nan)
        s["kept"] = ~s["base_failed"] & ~(s["quality"] < KEEP_FROM)
        parts.append(s)
    names = (*STATS, "base_failed", "quality", "kept")
    kinds = {"base_failed": bool, "kept": bool, "quality": float}
    return {k: np.concatenate([np.zeros(0, kinds.get(k, np.int64)), *(p[k] for p in parts)]) for k in names}


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """The model of a bounded sample of labelled documents (``rows`` of them, chosen by hash).

    Labels with a null in doc_id or quality are left out; a doc_id with several labels counts
    as bad if one of them is. Only the sampled ids are broadcast."""
    ids = written(labels.filter("doc_id is not null and quality is not null")
                  .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels may cover other documents
                  .groupBy("doc_id").agg(F.min("quality").alias("label"))
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled-ids")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")
    return train(sample, rows=rows)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and quality (the calibrated probability).

    Null and empty texts have no words and fail the base rule; rows are judged one by one, so
    repeated rows get the same result; without labels of both classes the base rule alone
    decides (quality is null). Other columns are not read."""
    model = trained(docs, labels, rows)
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, kept boolean, quality double"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = judged(b.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(s[k].astype(np.int64)) for k in STATS), pa.array(s["base_failed"]), pa.array(s["kept"]),
                 pa.array(s["quality"], mask=np.isnan(s["quality"]))],
                names=["doc_id", *STATS, "base_failed", "kept", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, out)


def passing(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns."""
    model = trained(docs, labels, rows)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(judged(b.column(at), model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
