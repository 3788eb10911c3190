"""The training-data operators against brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qtrlens.llm import ann, licenses, mixing, packing, quality_rules, quality_weak, simhash, tokens, tokenscan, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, row string, kept boolean"


def _texts():
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(names, rng.integers(1, 200))) for _ in range(60)]
    out += [None, "", " \n\t ", "one", "A b C", out[0], out[0], out[1] + " extra", "All rights  reserved. x " * 3, "Released under the MIT License, CC BY!",
            "x\x00y \u00e9t\u00e9 \u4e2d\u6587 <|endoftext|> z", "long " * 30_000, "a\nb\n\na\na b\n"]
    return out


def _rows():
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), 5, 6, "r", True) for i, t in enumerate(_texts())]
    return rows + [(None, "null id text", None, "", None, None, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def _print(text):
    import xxhash
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs):
    rows = [(r[0], _print(r[1])) for r in _rows()]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2 and part[a] != part[b]:
                part = [part[b] if p == part[a] else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    want = collections.Counter((i, f"{f:016x}", least[p]) for (i, f), p in zip(rows, part))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(part))


def test_every_pair_within_the_radius_collides():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_quality_rules_equal_brute_force(docs, labels):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.quality_rules(docs, labels).collect())
    want = collections.Counter()
    for i, t, *_ in _rows():
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + d for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want
    assert quality_rules.passing(docs, labels).columns == docs.columns


def test_quality_rules_without_labels_use_the_base_rule(docs, labels):
    got = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.quality is None for r in got)


def test_quality_rules_sample_labels_of_the_documents_at_hand(spark, docs):
    far = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality_rules.trained(docs, far, rows=40) is not None


def test_quality_models_on_held_out_documents(spark):
    root = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = quality_rules.quality_rules(d, l.filter("doc_id % 2 = 0")).join(l.filter("doc_id % 2 = 1"), "doc_id").select("base_failed", "kept", l.quality).collect()
    judged = [(r.kept, r[2]) for r in got if not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)
    weak = quality_weak.weak_quality(d).join(l, "doc_id").select("kept", l.quality).collect()
    assert sum(r.kept == bool(r.quality) for r in weak) >= 0.95 * len(weak)


def test_weak_estimate_finds_the_better_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    votes = np.zeros((4000, len(quality_weak.LABELLERS)), int)
    for k, right in enumerate((0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.6, 0.95)):
        votes[:, k] = np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    code, n = np.unique(quality_weak.pattern(votes), return_counts=True)
    model = quality_weak.estimate(code, n)
    p = np.array([model["posterior"][c] for c in quality_weak.pattern(votes)])
    assert ((p > 0.5) == truth).mean() > 0.97 and model["right"][0][0] > model["right"][0][6]


def test_weak_estimate_is_the_same_at_any_size():
    v = np.zeros((3, len(quality_weak.LABELLERS)), int)
    v[0, 6] = v[0, 7] = 1
    v[2, 0] = v[2, 1] = v[2, 7] = -1
    code = quality_weak.pattern(v)
    for n in ([93, 7, 0], [80, 7, 13]):
        few, many = (quality_weak.estimate(code, np.array(n) * k)["posterior"] for k in (1, 10_000))
        assert all(abs(few[c] - many[c]) < 1e-6 for c in code)
        assert many[code[0]] > 0.5 and many[code[1]] > 0.5


def test_weak_sample_draws_copies_one_by_one(spark):
    rng = np.random.default_rng(5)
    names = ["river", "stone", "garden", "window", "letter", "summer", "market", "bridge", "silver", "winter"]
    rows = [(i, " ".join(rng.choice(names, 6, replace=False))) for i in range(3000)]
    rows += [(10_000 + i, "#$% !! #$% #$% !! &&& #$% !! #$% !! #$%") for i in range(600)]
    model = quality_weak.trained(spark.createDataFrame(rows, "doc_id long, text string"), rows=40)
    assert model["scorer"] is not None


def test_mixing_meets_its_targets(docs):
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in _rows())
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[(r.source_size, r.target)] += r.taken
    assert all(abs(t - k[1]) <= max(3, 0.01 * k[1]) for k, t in by.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_small_sources_beside_a_large_one_meet_their_targets(spark):
    large = "select 'large' as source, 300L as size, xxhash64(id) as key from range(1000000)"
    small = "select concat('one', id) as source, 300L as size, xxhash64(id) as key from range(3) union all select 'two', 7L + id, xxhash64(id) from range(2)"
    words = "select 'words' as source, 1L as size, xxhash64(id) as key from range(40000)"
    sized = spark.sql(f"{large} union all {small} union all {words}")
    sources, quotas = mixing._planned(sized, 20, mixing.WEIGHTS)
    got = quotas.groupBy("rank").agg(F.sum("take").alias("take")).join(sources, "rank").collect()
    assert {r.source for r in got} == {"large", "one0", "one1", "one2", "two", "words"}
    assert all(r.target > 0 and abs(r["take"] - r.target) <= max(1, 0.01 * r.target) for r in got)


def test_targets_and_sainte_lague():
    assert [float(x) for x in mixing.targets([10, 100, 10], [5, 2, 1])] == [30.0, 60.0, 30.0]
    w, seats = [5.3, 3.1, 1.6, 0.0], np.zeros(4, int)
    for _ in range(17):
        seats[np.argmax(np.array(w) / (2 * seats + 1))] += 1
    assert (mixing.sainte_lague(np.array(w), 17) == seats).all()


def test_packing_is_a_round_trip(docs):
    whole = tokens.Encoder().whole
    ids = collections.defaultdict(list)
    for r in _rows():
        ids[r[0]].append(whole.encode(r[1] or "", add_special_tokens=False).ids + [2])
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][0][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 3


def test_exact_complements_fill_sequences():
    plan = packing.combinations({600: 3, 424: 2, 300: 1, 124: 1, 1024: 2, 500: 1, 262: 2})
    assert sum(t for _, t in plan) == 6 and ({600: 1, 424: 1}, 2) in plan


def test_token_counts_equal_the_tokenizer(docs):
    whole = tokens.Encoder().whole
    whole.encode_special_tokens = True
    want = collections.Counter((r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in _rows())
    assert collections.Counter(tuple(r) for r in tokenscan.token_counts(docs).collect()) == want


def test_separator_scan_stitches_blocks(spark, tmp_path):
    flat = np.array([7, 7, 9, 9, 1, 2, 3, 4, 5, 6, 8, 9, 3], "<u2")
    flat.tofile(tmp_path / "a.u16")
    (tmp_path / "b.u16").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.u16", "b.u16")], "path string")
    got = tokenscan.scan(spark, paths, separator=9, block_tokens=3).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens) for r in got] == [(0, 0, 2), (1, 3, 0), (2, 4, 7), (3, 12, 1)]


def test_license_scan(spark, docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    texts = dict(r[:2] for r in _rows())
    for i, r in got.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
        at = [(k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
    assert [r.labels for r in got.values() if "MIT" in (texts[r.doc_id] or "")] == ["cc-by,mit"]


def test_license_sql_agrees(spark, duck):
    root = "/root/testdata/sf0.001"
    got = licenses.scan(spark.read.parquet(f"{root}/documents.parquet"))
    want = duck.execute(licenses.duckdb_sql()).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    rows = [(1, "http://a/\r\nx", big, 0), (0, None, big, 0), (2, "u", "small", 0), (3, "u", "small", 0), (4, "u", None, 0), (5, "u", "\r\n\r\n" * 40, 0), (5, "u", "\r\n\r\n" * 40, 0), (None, "u", big, 0)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")).collect()
    body = lambda h: (h or "").encode()
    want = [(p, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "revisit" if h == big and p != 0 else "response", 0 if h == big and p != 0 else None) for p, _, h, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_url_filter(spark):
    rows = [(0, "https://www.Example.com/en/1"), (1, "http://x.example.com/en/a?b=1"), (2, "http://example.com/fr"), (3, "http://a.net/es/x#y"), (4, "http://a.net"), (5, None), (6, "no scheme"), (7, "x://spam.org/q")]
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(spark.createDataFrame([(i, u, "h", 1) for i, u in rows] * 5, "page_id long, url string, host string, depth int")).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("x.example.com", "/en/a", "example.com/en/", "block")
    assert got[2] == ("example.com", "/fr", "com/", "allow") and got[3] == ("a.net", "/es/x", "net/es/", "block")
    assert got[4][:3] == ("a.net", "", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("spam.org", "/q", None)
    assert all(v[3] in ("allow", "block") for v in got.values())


def test_url_sample_has_both_verdicts_where_urls_have_many_copies(spark):
    rules = (("allow", "a.com", "/"), ("block", "b.net", "/"))
    pages = spark.range(2000).selectExpr("id as page_id", "if(id % 2 = 0, 'https://a.com/en/x', 'https://b.net/es/x') as url")
    pages = pages.unionAll(spark.createDataFrame([(5000, "https://d.com/en/x"), (5001, "https://d.net/es/x")], "page_id long, url string"))
    got = {r.page_id: r.verdict for r in urls.judged(pages, rules, sample_rows=50).filter("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (420, [0.0] * 16, 0), (440, [float("nan")] * 16, 0), (460, [None] + [1.0] * 15, 0), (480, [1.0], 0), (None, x[0].tolist(), 0), (401, x[1].tolist(), 0)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 20 == 0, k=10, block_rows=150).collect()
    y = np.concatenate([x, x[1:2]]).astype("f4").astype(float)
    ids, hit = np.append(np.arange(400), 401), 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 400, 20))
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        hit += len({f[1] for f in found} & set(ids[np.lexsort((ids, -s))[:10]]))
    assert hit >= 0.9 * 10 * len(by)


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (licenses.scan(none), mixing.mix(none), mixing.mixed(none), quality_rules.quality_rules(none, labels), quality_weak.weak_quality(none), quality_weak.passing(none),
                packing.pack(none), simhash.near_duplicates(none), simhash.one_of_each(none), tokenscan.token_counts(none), warc.round_trip(pages), urls.judged(pages),
                ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)):
        assert out.count() == 0
