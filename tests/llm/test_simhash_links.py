"""Links found in buckets, and by midpoints where buckets are full, against all pairs."""

import numpy as np
import pytest

from qtrlens.llm import simhash


def prints():
    """Loose values, pairs at every distance up to four, a chain, and a crowd around one value."""
    rng = np.random.default_rng(3)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    loose = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    near = [flip(x, n) for n in (1, 2, 3, 4) for x in loose[:10]]
    chain = [loose[20]]
    for _ in range(6):
        chain.append(flip(chain[-1], 2))
    crowd = [flip(loose[30], n) for n in (1, 2, 3) for _ in range(30)]
    return sorted({x - (1 << 64) if x >> 63 else x for x in [0, *loose, *near, *chain, *crowd]})


def parts(nodes, edges):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize("most", (1, 4, simhash.MOST, 1000))
def test_links_connect_what_is_within_the_radius(spark, most):
    nodes = prints()
    want = [(a, b) for a in nodes for b in nodes if b < a and apart(a, b) <= 2]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"), most=most).collect()]
    assert all(apart(u, v) <= 2 for u, v in got) and len(got) == len(set(got))
    assert parts(nodes, got) == parts(nodes, want)
    if most == 1000:  # every link lies in some bucket
        assert set(got) == set(want)


def test_the_tables_find_the_links(spark, monkeypatch):
    """With one table left, only pairs that agree on its bits are found."""
    nodes = prints()
    mask = simhash.covering_masks(2)[0]
    monkeypatch.setattr(simhash, "covering_masks", lambda radius: [mask])
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"), most=1000).collect()}
    assert got == {(a, b) for a in nodes for b in nodes if b < a and apart(a, b) <= 2 and not (a ^ b) & mask}
