"""Lines at the similarity of 0.8 against brute force."""

import numpy as np

from depthwise.llm import line_dedup
from test_joins import EMPTY, brute_lines


def test_one_word_changed(spark, words):
    """One word changed of 9 to 18: a similarity between 0.8 and 0.9. Of 8 words it is below 0.8, and the line stays."""
    r = np.random.default_rng(5)
    rows = []
    for k, n in enumerate([8, *range(9, 19)] * 3):
        line = list(r.choice(words, n, replace=False))
        near = [*line[:-1], f"changed{k}"]
        rows.append((k, " ".join(line) + "\n" + " ".join(near[::-1]), "en", "s", 1))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == brute_lines(rows, 0.8)
    assert all(("\n" in got[k]) == (k % 11 == 0) for k in got)


def test_corpus(spark, corpus):
    rows, df = corpus
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == brute_lines(rows, 0.8)
