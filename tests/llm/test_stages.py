"""Targets, votes, posteriors and URL rules against brute force; held-out URLs; every stage of the
corpus pipeline and all of it."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from qtrlens.llm import mixing, quality_rules, quality_weak, simhash, tokens, urls
from qtrlens.llm.textscan import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_targets_share_by_weight_and_stop_at_the_limit():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 9)
        sizes, weights = [rng.choice([0, 1, 5, 100, 10**6]) for _ in range(n)], [rng.choice([5, 2, 1]) for _ in range(n)]
        got = mixing.targets(sizes, weights)
        assert all(0 <= t <= 3 * s for t, s in zip(got, sizes)) and sum(got) == sum(sizes)
        # whoever is below the limit has what the weights say, and no source at its limit would get less by them
        level = {t / w for t, w, s in zip(got, weights, sizes) if t < 3 * s}
        assert len(level) <= 1
        assert all(Fraction(3 * s, w) <= bar for t, w, s in zip(got, weights, sizes) for bar in level if t == 3 * s)


def _votes(text):
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return [0] * 8
    n, chars = len(words), sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    upper, letters = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    x = [symbols / n, symbols / max(chars, 1), upper / max(letters, 1), text.count("!") / n, len(repeated) / n, dup / (text.count("\n") + 1), abs(chars / n - 5.5)]
    x.append(max(v / bad for v, (_, _, bad) in zip(x, quality_weak.LABELLERS)))
    return [-1 if v >= bad else 1 if good is not None and v <= good else 0 for v, (_, good, bad) in zip(x, quality_weak.LABELLERS)]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the small table and odd ones, with columns that clash with the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [None, "", " \n\t ", "one", "AB! CD! ## $$ %%", "a a a\n" * 200, "x\x00y été 中文 <|endoftext|> z", "long " * 30_000, "Good prose, mostly. " * 3]
    rows = [(10_000 + i, t, None, None if i % 2 else "s", None) for i, t in enumerate(texts)] + [(None, "no id " * 60, "en", "s", 1), (10_004, texts[4], None, "s", None)]
    extra = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(extra).selectExpr("*", "1 as size", "'k' as kept", "2L as __a", "3 as component_id", "'x' as label").repartition(4).cache()


def _all_rows(df):
    return collections.Counter(map(repr, df.collect()))


def test_votes_and_posteriors_equal_brute_force(odd):
    import pyarrow as pa
    texts = [r.text for r in odd.select("text").collect()]
    want = np.array([_votes(t) for t in texts])
    got = np.concatenate([quality_weak.votes(data, off) for _, _, data, off in chunks(pa.array(texts, pa.string()))])
    assert (got == want).all()
    # expectation-maximisation text by text, one text at a time
    code = quality_weak.pattern(want.astype(np.int8))
    values, counts = np.unique(code, return_counts=True)
    label = quality_weak.estimate(values, counts.astype(float))
    weight, v = quality_weak.SCALED_TO / len(texts), want.tolist()
    prior, good = quality_weak.PRIOR_VOTES, quality_weak.PRIOR_GOOD / (quality_weak.PRIOR_GOOD + quality_weak.PRIOR_BAD)
    share = [[[p / sum(prior) for p in side] for _ in range(8)] for side in (prior, prior[::-1])]
    for _ in range(quality_weak.ROUNDS):
        post = []
        for row in v:
            odds = math.log(good / (1 - good)) + sum(math.log(share[0][k][x + 1] / share[1][k][x + 1]) for k, x in enumerate(row))
            post.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
        new = []
        for side, first in ((0, prior), (1, prior[::-1])):
            new.append([])
            for k in range(8):
                seen = list(first)
                for row, p in zip(v, post):
                    seen[row[k] + 1] += weight * (p if side == 0 else 1 - p)
                new[-1].append([s / sum(seen) for s in seen])
        moved = max(abs(a - b) for s in (0, 1) for k in range(8) for a, b in zip(share[s][k], new[s][k]))
        share = new
        good = (weight * sum(post) + quality_weak.PRIOR_GOOD) / (weight * len(v) + quality_weak.PRIOR_GOOD + quality_weak.PRIOR_BAD)
        if moved < 1e-9:
            break
    assert [label["posterior"][int(c)] for c in code] == pytest.approx(post, abs=1e-6)


def test_weak_quality_of_odd_rows(odd):
    got = quality_weak.weak_quality(odd).collect()
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_good, r.n_bad, r.posterior, r.score, r.kept))
    assert len(got) == odd.count() and len(by_id[10_004]) == 1  # equal rows, equal results
    votes = {r.doc_id: _votes(r.text) for r in odd.select("doc_id", "text").collect()}
    for i, (only,) in by_id.items():
        assert (only[0], only[1]) == (votes[i].count(1), votes[i].count(-1)) and 0 <= only[2] <= 1 and 0 <= only[3] <= 1


def _judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(12)
    part = lambda xs, n: "".join(rng.choice(xs) for _ in range(rng.randint(0, n)))
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "badexample.com", "a.net", "net", "x.net:80", "é.net", "", "example.com.org"]
    made = [rng.choice(["http://", "https://", "x://", "", "://"]) + rng.choice(hosts) + rng.choice(["", "/", "/en/", "/en", "/es/a", "/fr/", "//es/"]) + part(["?", "#", "/en/", "a", "://", "1"], 4) for _ in range(400)]
    made += [None, "", "http://a.net/es/" + "x" * 100_000 + "?" + "k=1&" * 20_000, "https://example.com/EN/"]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(made)], "page_id long, url string, html string, rule string, suffix string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert len(got) == len(made)
    for i, u in enumerate(made):
        host, path, rule, verdict = _judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_judge_held_out_urls(spark):
    """Labelled URLs whose verdict shows in their form, on the same hosts; some labelled twice, with both verdicts."""
    rng = random.Random(13)

    def url(bad):
        host = rng.choice(["a.org", "b.info", "c.io"])
        word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
        if bad:
            return f"https://{host}/{rng.randint(10**8, 10**12)}?" + "&".join(f"{word(2)}={rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 7)))
        return f"https://{host}/" + "/".join(word(rng.randint(3, 8)) for _ in range(rng.randint(1, 3)))

    marked = [(url(bad), "block" if bad else "allow") for bad in [True, False] * 300]
    labelled = spark.createDataFrame(marked + [("https://a.org/both", "allow"), ("https://a.org/both", "block")], "url string, verdict string")
    held = [(i, url(i % 2 == 0)) for i in range(400)]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(held, "page_id long, url string"), labelled=labelled).collect()}
    assert len(got) == 400 and sum(got[i] == ("block" if i % 2 == 0 else "allow") for i, _ in held) >= 0.95 * 400


# ---- the pipeline ---------------------------------------------------------------------------

STAGE = dict(corpus_pipeline.STAGES)


def _of(df, columns):
    return _all_rows(df.select(*columns))


def test_stages_are_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_filtering_stages_keep_what_their_operators_keep(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, verdict in (("quality_rules", quality_rules.quality_rules(odd, labels)), ("quality_classifier", quality_weak.weak_quality(odd))):
        kept = STAGE[name](spark, odd, SF)
        assert kept.columns == odd.columns
        ids = collections.Counter(r.doc_id for r in verdict.where("kept").collect())
        assert collections.Counter(r.doc_id for r in kept.collect()) == ids and 0 < kept.count() < odd.count()
        assert not _all_rows(kept) - _all_rows(odd)  # whole rows, none made up


def test_quality_rules_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id")
    kept = {r.doc_id for r in STAGE["quality_rules"](spark, docs, SF).collect()}
    clean = [r for r in good.collect() if len(WORD.findall(r.text or "")) >= 50]
    assert len([r for r in clean if r.doc_id in kept]) >= 0.95 * len(clean)


def test_simhash_stage_keeps_one_of_each_group(spark, odd):
    kept = STAGE["simhash_near_dedup"](spark, odd, SF)
    assert kept.columns == odd.columns and not _all_rows(kept) - _all_rows(odd)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd, shingle_words=3, radius=2).collect()}
    found = collections.Counter(groups[r.doc_id] for r in kept.collect())
    assert set(found) == set(groups.values()) and max(found.values()) == 1


def test_mixing_stage_takes_the_mix(spark, odd):
    kept = STAGE["mixing"](spark, odd, SF)
    assert kept.columns == odd.columns
    taken = collections.Counter()
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    texts = collections.defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].add(" ".join(WORD.findall(r.text or "")))
    for r in kept.select("doc_id", "text", "n_chars").collect():
        w = WORD.findall(r.text or "")
        got[r.doc_id] += len(w)
        assert any(f" {' '.join(w)} " in f" {t} " for t in texts[r.doc_id])  # a stretch of the document's words
    assert got == +taken


def test_packing_stage_places_every_token_once(spark, odd):
    whole = tokens.Encoder().whole  # special strings in a text are their ids
    want = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.select("text").collect())
    got = STAGE["best_fit_packing"](spark, odd, SF).collect()
    assert sum(r.length for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_stages_of_no_documents(spark, odd):
    none = odd.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_the_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(ids))
    ids = {r.doc_id for r in quality_weak.weak_quality(left).where("kept").collect()}
    left = left.where(left.doc_id.isin(ids))
    left = simhash.one_of_each(left, shingle_words=3, radius=2)
    mix = {r.doc_id: r.taken for r in mixing.mix(left).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, n in mix.items() if n}
    whole = tokens.Encoder().whole
    text = {r.doc_id: r.text for r in left.collect()}
    sizes = {r.doc_id: r.size for r in mixing.mix(left).collect()}
    for i, n in mix.items():  # documents taken whole, once or more: their tokens as often
        if n and n % sizes[i] == 0 and n // sizes[i] >= 1:
            length = len(whole.encode(text[i], add_special_tokens=False).ids) + 1
            mine = sum(r.length for r in got if r.doc_id == i)
            assert mine >= length
