"""Two lines of a family have many pairs of tokens in common, but come to the last comparison once."""

import pytest

from depthwise.llm import line_dedup
from test_joins import EMPTY, brute_lines
from test_line_families import family


@pytest.mark.parametrize("known", [16, 1])
def test_meet_once(spark, words, monkeypatch, known):
    """Results are right, too, where a row knows fewer pairs of tokens than its line has."""
    monkeypatch.setattr(line_dedup, "KNOWN", known)
    monkeypatch.setattr(line_dedup, "BEFORE", 1)
    made, rest = [], line_dedup._rest

    def counted(*args):
        out = rest(*args)
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(line_dedup, "_rest", counted)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(family(words, 120))]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == brute_lines(rows, 0.8)
    [(n, different)] = made
    assert different > 10
    assert n == different if known == 16 else n > different
