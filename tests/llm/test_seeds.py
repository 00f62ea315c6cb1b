"""Seeds of decontamination: every substitution pattern within the tolerance has a hit."""

from itertools import combinations

import numpy as np
import pytest

from depthwise.llm import decontaminate
from depthwise.llm.numtext import U64


@pytest.mark.parametrize("n", range(decontaminate.SHORTEST, decontaminate.OVERLAP + 1))
def test_masks_cover_all_patterns(n):
    allowed = decontaminate.substitutions(n, decontaminate.AGREEMENT)
    assert allowed == n // 5
    masks = decontaminate.covering_masks(n, allowed)
    places = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    assert all(any(not p & set(pattern) for p in places) for pattern in combinations(range(n), allowed))


@pytest.mark.parametrize("length", [5, 9, 10, 12, 15, 16, 30])
def test_all_patterns_are_found(length):
    """Items alone, and beside items of all other lengths, with every pattern of substitutions in one overlap."""
    r = np.random.default_rng(length)
    word = lambda n: r.integers(0, 1 << 63, n, dtype=U64)
    items = [(n, word(n)) for n in range(5, 31)]
    item = dict(items)[length]
    n = min(length, decontaminate.OVERLAP)
    for table in (decontaminate.SeedTable([(length, item)], 16, 0.8), decontaminate.SeedTable(items, 16, 0.8)):
        for k in range(n // 5 + 2):
            for pattern in combinations(range(n), k):
                passage = item[length - n :].copy()
                passage[list(pattern)] = word(k)
                got = {table.ids[m] for m in table.matches(np.concatenate([word(7), passage, word(5)]))}
                assert got == ({length} if k <= n // 5 else set())


def test_longer_overlaps():
    assert decontaminate.substitutions(50, 0.8) == 10
    # in parts, of which one has its share of the substitutions at most; a run of ones alone would have four positions
    assert decontaminate.covering_masks(50, 10) == decontaminate.covering_masks(12, 2) and all(m.count("1") >= 6 for m in decontaminate.covering_masks(50, 10))
    assert decontaminate.covering_masks(40, 0) == ("1" * 32,)
