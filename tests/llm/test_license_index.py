"""Every template planted whole, cut and shifted, against a search word by word; the plan's size."""

import random
import re

import pytest

from qtrlens.llm import licenses

TEMPLATES = licenses._templates()


def planted():
    rng = random.Random(7)
    noise = ["the", "of", "license", "copyright", "and", "or", "x", "é", "version", "all", "rights"]
    rows, filler = [], lambda n: [rng.choice(noise) for _ in range(n)]
    for k, (_, words, must, _) in enumerate(TEMPLATES):
        rows.append((10 * k, " ".join(filler(5) + words + filler(5)).upper()))
        rows.append((10 * k + 1, " ".join(words[must[0] + 1 :])))  # begins before the text does
        rows.append((10 * k + 2, ", ".join(filler(3) + words[: must[-1]])))  # a key word is missing
        changed = [w if j in must else "zz" for j, w in enumerate(words)]
        rows.append((10 * k + 3, "\n".join(changed + words)))  # key phrases alone, then all of it
    rows += [(900, " ".join(w for _, words, _, _ in TEMPLATES for w in words) * 3), (901, None), (902, ""), (903, "-"), (900, "all rights reserved")]
    return rows


def brute(text, weights):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = []
    for label, words, must, base in TEMPLATES:
        for o in range(len(w)):
            there = [o + j < len(w) and w[o + j] == x for j, x in enumerate(words)]
            if all(there[j] for j in must):
                total = sum(weights[x] for x in words)
                starts.append((label, base, o, round(sum(weights[x] for x, ok in zip(words, there) if ok) / total, 9)))
    at = [o for _, base, o, _ in starts if base]
    names = lambda keep: ",".join(sorted({s[0] for s in starts if keep(s)}))
    return (len(w), len(at), min(at, default=None), max(at, default=None), names(lambda s: s[1]),
            names(lambda s: s[3] >= licenses.LABEL_FROM), max((s[3] for s in starts), default=0.0))


@pytest.mark.parametrize("flat", (False, True))
def test_planted_templates_equal_a_search_word_by_word(spark, flat):
    rows = planted()
    docs = spark.createDataFrame([(i, t, i, "w") for i, t in rows], "doc_id long, text string, words long, rare string")
    weights = licenses.idf(docs)
    if flat:  # other weights file the templates under other words and find the same places
        weights = dict.fromkeys(weights, 1.0)
    got = sorted((r.doc_id, *tuple(r)[1:7], round(r.score, 7)) for r in licenses.scan(docs, weights).collect())
    want = [(i, *brute(t, weights)) for i, t in rows]
    assert sorted(map(str, got)) == sorted(str((*x[:7], round(x[7], 7))) for x in want)


def test_templates_are_filed_under_their_two_rarest_mandatory_words():
    weights = {w: 1.0 + len(w) for _, words, _, _ in TEMPLATES for w in words}
    first, second = licenses._index(weights)
    for k, (_, words, must, _) in enumerate(TEMPLATES, 1):
        filed = [w for index in (first, second) for w, ps in index.items() for p in ps if -(-p // licenses.SPAN) == k]
        assert sorted(map(len, filed)) == sorted(len(words[j]) for j in must)[-2:]


def test_the_plan_does_not_grow_with_the_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")

    def nodes():
        weights = {w: 1.0 for _, words, _, _ in licenses._templates() for w in words}
        return licenses.scan(docs, weights)._jdf.queryExecution().analyzed().toString().count("lambdafunction")

    before = nodes()
    monkeypatch.setattr(licenses, "TEMPLATES", licenses.TEMPLATES * 5)
    assert nodes() == before
