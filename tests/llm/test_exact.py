"""Equality where a hash would do nearly always, and vectors of several lengths."""

import numpy as np
import pytest

from qtrlens.llm import ann, quality_rules, textscan


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_unequal_lines_and_windows_are_not_equal(spark):
    line = _thue_morse(1024)
    other = line.translate(str.maketrans("ab", "ba"))
    texts = {1: f"{line}\n{other}", 2: f"{line}\n{line}", 3: f"x {line} y\nx {other} y", 4: f"x {line} y\nx {line} y"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(df, none).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (1, 6)}


def test_codes_are_equal_only_for_equal_spans():
    data = np.frombuffer(b"aa b aa  b c", np.uint8)
    starts, ends = np.array([0, 3, 5, 9, 11]), np.array([2, 4, 7, 10, 12])
    code = textscan.span_codes(data, starts, ends)
    assert code[0] == code[2] and code[1] == code[3] and len(set(code)) == 3
    touching = textscan.span_codes(np.frombuffer(b"abab", np.uint8), np.array([0, 2]), np.array([2, 4]))
    assert touching[0] == touching[1]
    rows = textscan.row_codes(np.array([1, 1, 2]), np.array([5, 5, 5]))
    assert rows[0] == rows[1] != rows[2] and len(textscan.row_codes(np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("k", [5, 20])
def test_vectors_of_every_length_are_searched(spark, k):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=(3 if i % 8 == 0 else 8))], "e") for i in range(160)]
    rows += [(1_000, [1.0], "alone"), (1_020, [0.5, 0.5], "pair"), (1_021, [0.5, 0.25], "pair"), (1_040, [], "empty"), (1_060, [float("nan")], "bad")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").repartition(4)
    got = {}
    for r in ann.neighbours(df, "vec_id % 20 = 0", k=k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {i: np.array(v) for i, v, _ in rows if v and np.isfinite(v).all()}
    hits = wanted = 0
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted(((-float((vectors[i] * vectors[q]).sum()), i) for i in vectors if i != q and len(vectors[i]) == len(vectors[q])))[:k]
        mine = sorted(got.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(near) + 1))
        assert all(s == float((vectors[i] * vectors[q]).sum()) for _, i, s in mine)
        hits, wanted = hits + len({i for _, i in near} & {i for _, i, _ in mine}), wanted + len(near)
    assert hits >= 0.9 * wanted and 1_000 not in got and [r[1] for r in got[1_020]] == [1_021]
