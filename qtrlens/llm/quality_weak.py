"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every text. Their accuracies
come from expectation-maximisation over the counts of all vote patterns (at most 3^8 of
them, so all documents take part and only pattern counts reach the driver). The patterns'
posteriors are the soft labels of a bounded sample on which a hashed linear scorer is
trained; the scorer then judges every text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE_ROWS, fit_texts, probability, raw_scores
from .quality_rules import statistics
from .store import written
from .textscan import SpanHash, chunks, per_text

#: (statistic, good up to, bad from): between the two a labeller abstains; None: it has no
#: such vote. Kinds of junk exclude each other, so only ``worst`` (the largest ratio of the
#: others to their limits) vouches for a text, and each kind has two labellers that overlap.
LABELLERS = (
    ("symbols_per_word", None, 0.3),
    ("symbols_share", None, 0.05),
    ("capitals_share", None, 0.5),
    ("shouts_per_word", None, 0.2),
    ("repeated_share", None, 0.6),
    ("repeated_lines_share", None, 0.6),
    ("word_length_off", 2.0, 6.0),
    ("worst", 0.4, 1.0),
)
#: A text goes if the scorer's probability of good quality is below this.
KEEP_FROM = 0.5
#: Pseudo-counts of votes (bad, none, good) on good texts (on bad ones reversed), and of good
#: and bad texts: they tell the classes apart and keep a corpus without bad texts as it is.
PRIOR_VOTES, PRIOR_GOOD, PRIOR_BAD = (1.0, 20.0, 20.0), 9.0, 1.0
#: Texts that the pattern counts are scaled to, so the pseudo-counts weigh the same at any size.
SCALED_TO = 500.0
ROUNDS = 200


def votes(data, off) -> np.ndarray:
    """One column per labeller: 1 good, -1 bad, 0 no vote (texts without words get none)."""
    s = statistics(data, off)
    n = np.maximum(s["n_words"], 1)
    upper = per_text((data >= 65) & (data <= 90), off)
    letters = np.maximum(upper + per_text((data >= 97) & (data <= 122), off), 1)
    lines = np.maximum(per_text(data == 0x0A, off) + 1, 1)
    x = {"symbols_per_word": s["n_symbols"] / n, "symbols_share": s["n_symbols"] / np.maximum(s["word_chars"], 1), "capitals_share": upper / letters,
         "shouts_per_word": per_text(data == 0x21, off) / n, "repeated_share": s["n_repeat_words"] / n,
         "repeated_lines_share": s["n_dup_lines"] / lines, "word_length_off": np.abs(s["word_chars"] / n - 5.5)}
    x["worst"] = np.max([x[k] / bad for k, _, bad in LABELLERS if k in x], 0)
    out = np.stack([np.where(x[k] >= bad, -1, np.where(x[k] <= (-1 if good is None else good), 1, 0)) for k, good, bad in LABELLERS], 1)
    return np.where(s["n_words"][:, None] > 0, out, 0).astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    """The votes as one base-3 number."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)


def unpacked(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


def estimate(code: np.ndarray, count: np.ndarray) -> dict:
    """Each labeller's vote shares on good and on bad texts, the share of good texts and each
    pattern's posterior of good quality, by expectation-maximisation on pattern counts. Only the
    mix of patterns matters, not how many texts there are."""
    v, count = unpacked(code), count * (SCALED_TO / count.sum())
    cast = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
    prior = np.array([PRIOR_VOTES, PRIOR_VOTES[::-1]])
    shares = np.repeat((prior / prior.sum(1, keepdims=True))[:, None], len(LABELLERS), 1)  # class, labeller, vote
    good = PRIOR_GOOD / (PRIOR_GOOD + PRIOR_BAD)
    for _ in range(ROUNDS):
        odds = np.log(good) - np.log1p(-good) + np.einsum("plv,lv->p", cast, np.log(shares[0]) - np.log(shares[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        seen = np.einsum("cp,plv->clv", np.array([p * count, (1 - p) * count]), cast) + prior[:, None]
        before, shares = shares, seen / seen.sum(2, keepdims=True)
        good = ((p * count).sum() + PRIOR_GOOD) / (count.sum() + PRIOR_GOOD + PRIOR_BAD)
        if np.abs(shares - before).max() < 1e-9:
            break
    right = [(shares[0, :, 2] / (shares[0, :, 0] + shares[0, :, 2])).tolist(), (shares[1, :, 0] / (shares[1, :, 0] + shares[1, :, 2])).tolist()]
    return {"right": right, "good": good, "posterior": dict(zip(code.tolist(), p.tolist()))}


def trained(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Label model of all documents, and the scorer of a bounded sample (``rows`` by hash of id
    and text, so copies of a text are drawn one by one).

    One pass over the texts writes each one's votes and hash; the patterns are counted and the
    sample is chosen from those, and only the chosen texts are read again. The sample takes half
    of its rows from patterns whose posterior is bad where there are so many, weighted back to
    the true share by the calibration; rows equal in id and text are drawn as one."""

    def count(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi, data, off in chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(data, off))), b.column(1).slice(lo, hi - lo)], names=["code", "k"])

    key = F.xxhash64(F.lit(11), "doc_id", F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select("text", key.alias("k"))
    marks = written(keyed.mapInArrow(count, "code long, k long"), "votes")
    got = marks.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    if not got:
        return {"label": None, "scorer": None}
    label = estimate(np.array([r.code for r in got]), np.array([r.n for r in got]))
    sizes = {r.code: r.n for r in got}
    n_bad = sum(n for c, n in sizes.items() if label["posterior"][c] < 0.5)
    n_good = sum(sizes.values()) - n_bad
    # at most 3^8 patterns; u puts the rows in a seeded order
    posterior = docs.sparkSession.createDataFrame(list(label["posterior"].items()), "code long, p double")
    drawn = marks.join(F.broadcast(posterior), "code").select("k", "p", (F.pmod("k", F.lit(1 << 53)) / F.lit(2.0**53)).alias("u")).distinct()
    half = rows // 2
    sides = [drawn.filter(c).orderBy("u", "k").limit(half) for c in ("p < 0.5", "p >= 0.5")]
    chosen = written(sides[0].unionAll(sides[1]), "votes-sample")

    def fit(batches):
        import pickle

        import pyarrow as pa

        table = pa.Table.from_batches(list(batches), schema=pa.schema([("text", pa.string()), ("p", pa.float64()), ("u", pa.float64())]))
        model = fit_texts(table.column("text"), table.column("p").to_numpy()) if len(table) else None
        if model:  # the sample holds more bad texts than the corpus: shift the odds back
            p = table.column("p").to_numpy()
            shift = np.log(n_good / max(n_bad, 1)) - np.log((p >= 0.5).sum() / max((p < 0.5).sum(), 1))
            model["platt"] = (model["platt"][0], model["platt"][1] + shift)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    import pickle

    texts = keyed.join(F.broadcast(chosen), "k").dropDuplicates(["k"]).select("text", "p", "u")
    whole = texts.repartition(1).sortWithinPartitions("u", "p", "text")
    found = whole.mapInArrow(fit, "model binary").collect()
    return {"label": label, "scorer": pickle.loads(bytes(found[0][0])) if found else None}


def judged(column, model) -> dict[str, np.ndarray]:
    """Votes for and against, ``posterior`` of the votes, ``score`` of the linear scorer (without
    one: the posterior) and ``kept`` of every text of an Arrow column."""
    hasher, parts = SpanHash(), []
    posterior, scorer = model["label"]["posterior"], model["scorer"]
    for _, _, data, off in chunks(column):
        v = votes(data, off)
        p = np.array([posterior[int(c)] for c in pattern(v)])
        score = probability(raw_scores(data, off, hasher, scorer), scorer) if scorer else p
        parts.append({"n_good": (v > 0).sum(1), "n_bad": (v < 0).sum(1), "posterior": p, "score": score, "kept": score >= KEEP_FROM})
    names = {"n_good": int, "n_bad": int, "posterior": float, "score": float, "kept": bool}
    return {k: np.concatenate([np.zeros(0, t), *(x[k] for x in parts)]) for k, t in names.items()}


def weak_quality(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_good and n_bad (votes), posterior, score and kept of every document.

    Null and empty texts get no votes, so their posterior is that of any text without votes;
    repeated rows get equal results; an empty table gives an empty result. Where the votes hold
    fewer than four bad (or good) texts no scorer is trained and the posterior decides. Other
    columns are not read."""
    model = trained(docs, rows)
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, n_good long, n_bad long, posterior double, score double, kept boolean"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = judged(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in s.values())], names=["doc_id", *s])

    return docs.select("doc_id", "text").mapInArrow(run, out)


def passing(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = trained(docs, rows)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(judged(b.column(at), model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
