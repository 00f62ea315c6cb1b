"""Repeats by neighbours in suffix order: stretches of long texts, and hashes that lie."""

import numpy as np
import pytest

from depthwise.llm import suffix_dedup
from test_suffix_dedup import brute, corpus


@pytest.mark.parametrize("stretch", [1, 37, 150])
def test_stretches(stretch, monkeypatch):
    data = [np.frombuffer((t or "").encode(), np.uint8) for _, t in corpus()]
    whole = [suffix_dedup.anchors(d) for d in data]
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    for d, w in zip(data, whole):
        assert all((a == b).all() for a, b in zip(suffix_dedup.anchors(d), w))


def test_lying_hashes(spark, monkeypatch):
    """Common extensions that come out too long are found out by the bytes."""
    common = suffix_dedup.Suffixes.common
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", lambda self, i, j: np.minimum(common(self, i, j) + 7, np.minimum(self.length[i], self.length[j])))
    lies = lambda rows: suffix_dedup.covered(*rows)
    pieces = [(b"%04d" % (k % 7)) * 10 + b"a" * 16 + b"anchor" * 5 + b"xy" + b"q%03d" % (k % 5) * 18 for k in range(40)]
    args = np.zeros(40, np.int64), np.arange(40), np.full(40, 56), np.full(40, 56), pieces
    got = lies(args)
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", common)
    assert got == lies(args) and got


def test_repeated_and_clashing(spark):
    """Rows that share an id and a text have one result each, and columns named as the operator's own do no harm."""
    text = "some words that are long enough to be a passage of more than a hundred bytes, said once and then said again here " * 2
    df = spark.createDataFrame([(1, text), (1, text), (2, "x"), (2, "x"), (None, text), (3, "y"), (3, text)], "doc_id long, text string").selectExpr("*", "'a' as runs", "3 as low")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    want = brute([(0, text), (1, text), (2, "x"), (3, "y")])
    assert [g for g in got if g[0] in (None, 1, 2)] == [(1, *want[1])] * 2 + [(2, *want[2])] * 2 + [(None, *want[0])]
    assert sorted(g[1] for g in got if g[0] == 3) == [1, len(text)]
