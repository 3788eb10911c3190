"""The index of sums against every combination of the lengths at hand."""

from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest

from qtrlens.llm import packing


def held(combo, spare):
    return all(spare[x] >= k for x, k in Counter(combo).items())


def brute(spare, gap, depth):
    """The size of the smallest combination of at most ``depth`` lengths that fills the gap."""
    lengths = [int(x) for x in np.flatnonzero(spare)]
    return next((n for n in range(1, depth + 1) for c in combinations_with_replacement(lengths, n)
                 if sum(c) == gap and held(c, spare)), None)


@pytest.mark.parametrize("seed", range(4))
def test_the_index_finds_an_exact_combination_if_there_is_one(seed):
    rng = np.random.default_rng(seed)
    avail = np.zeros(41, np.int64)
    for x in rng.choice(np.arange(1, 41), 9, replace=False):
        avail[x] = rng.integers(1, 4)
    sums = packing.SumIndex(avail)
    while avail.any():
        spare = avail.copy()
        spare[rng.choice(np.flatnonzero(spare))] -= 1  # a piece that the sequence already holds
        for gap in range(1, 41):
            for depth in (1, 2, 3):
                got, want = sums.exact(gap, spare, depth), brute(spare, gap, depth)
                assert (got and len(got)) == want
                assert got is None or (sum(got) == gap and held(got, spare))
        avail[rng.choice(np.flatnonzero(avail))] -= 1


def test_counts_are_used_up_and_no_sequence_overflows():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 65, 3000), rng.integers(20, 27, 500), np.full(7, 64), np.array([], int)):
        counts = dict(Counter(lengths.tolist()))
        used = Counter()
        for need, times in packing.combinations(counts, 64):
            assert times > 0 and sum(x * k for x, k in need.items()) <= 64
            used += Counter({x: k * times for x, k in need.items()})
        assert used == counts


def test_lengths_that_fill_sequences_exactly_leave_no_gap():
    counts = {40: 30, 24: 10, 14: 20, 10: 20, 12: 10, 6: 20}  # 40 + 24, 40 + 14 + 10, 40 + 12 + 6 + 6
    plan = packing.combinations(counts, 64)
    assert sum(times for _, times in plan) == -(-sum(x * n for x, n in counts.items()) // 64)
