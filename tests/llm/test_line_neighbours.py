"""Neighbouring tokens as keys: two rare ones, else three. No similar lines are missed, and few lines share keys by chance."""

import random

import pytest
from pyspark.sql import functions as F

from depthwise.llm import line_dedup
from test_joins import EMPTY, brute_lines


@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_nothing_missed(spark, threshold):
    """Lines of three to fourteen words, of which none to all are common, with words left out, added and replaced at random places."""
    r = random.Random(17)
    common = [f"c{k}" for k in range(12)]
    rows = []
    for k in range(600):
        n = r.randint(3, 14)
        line = r.sample(common, min(r.randint(0, n), 12))
        line += [f"w{k}x{i}" for i in range(n - len(line))]
        out = r.sample(line, r.randint(0, n // 4))
        near = [w for w in line if w not in out] + [f"v{k}x{i}" for i in range(r.randint(0, n // 4))]
        r.shuffle(near)
        rows.append((k, " ".join(line) + "\n" + " ".join(near), "en", "s", 1))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY), threshold=threshold).collect()}
    assert got == brute_lines(rows, threshold)
    assert 100 < sum("\n" not in t for t in got.values()) < 550


def test_common_words(spark, words, monkeypatch):
    """Lines of words that all stand in many lines: none are similar, and most keys stand in one line or two."""
    r = random.Random(18)
    rows = [(k, " ".join(r.sample(words, 30)), "en", "s", 1) for k in range(1500)]
    made, shared = [], line_dedup._shared

    def counted(members):
        out = shared(members)
        made.append(out.filter(F.col("k") > 2).count())
        return out

    monkeypatch.setattr(line_dedup, "_shared", counted)
    assert line_dedup.line_decisions(spark.createDataFrame(rows, EMPTY), "doc_id", "text").count() == 0
    assert made[0] < 6000, made
