"""Families of lines just below the similarity: right lines go, and few pairs come to the comparison of whole sets."""

import random

import pytest

from depthwise.llm import line_dedup
from test_joins import EMPTY, brute_lines


def family(words, size):
    """Lines of 30 words that share 25 with the family, similar (0.8 to 0.88) to some members only, each in a text of its own."""
    r = random.Random(6)
    base = r.sample(words, 30)
    return [" ".join(r.choice(words) if i in gone else w for i, w in enumerate(base)) for gone in ([*r.sample(range(30), 5)] for _ in range(size))]


def test_few_comparisons(spark, words, monkeypatch):
    texts = family(words, 120)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    compared, similar = [], line_dedup._similar

    def counted(texts, pairs, *more):
        compared.append(pairs.count())
        return similar(texts, pairs, *more)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == brute_lines(rows, 0.8)
    assert sum(compared) < 1000, compared  # of 7,140


@pytest.mark.parametrize("kind", ["string", "long"])
def test_slices_and_ids(spark, words, monkeypatch, kind):
    """Several slices, few lines tried first; ids that are no numbers, or too far apart to be put into one number with the line's."""
    monkeypatch.setattr(line_dedup, "SLICE_ROWS", 100)
    monkeypatch.setattr(line_dedup, "BEFORE", 1)
    texts = family(words, 60)
    rows = [(k, "\n".join(texts[2 * k : 2 * k + 2])) for k in range(30)]
    name = {k: f"id{k:04d}" if kind == "string" else (k - 15) * (1 << 59) for k, _ in rows}
    df = spark.createDataFrame([(name[k], t) for k, t in rows], f"doc_id {kind}, text string")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == {name[k]: t for k, t in brute_lines(rows, 0.8).items()}
