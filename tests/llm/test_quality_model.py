"""The classifier's parts against second versions, and tables with repeated rows and clashing names."""

import math
from collections import Counter

import numpy as np

from depthwise.llm import quality


def test_ratio():
    p, q = np.array([3, 0, 5]), np.array([1, 2, 0])
    want = [math.log((a + 1) / 11) - math.log((b + 1) / 6) for a, b in zip(p, q)]
    assert np.allclose(quality.log_count_ratio(p, q), want)


def test_descent_finds_the_optimum():
    """The dual's box-constrained problem solved by plain projected gradient steps."""
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(30) < 0.3).astype(np.int32) for _ in range(40)]
    y = np.where(r.random(40) < 0.4, 1, -1)
    ratio = r.normal(size=30)
    w = quality.dual_coordinate_descent(rows, y, ratio, epochs=2000)
    x = np.zeros((40, 31))
    for k, row in enumerate(rows):
        x[k, row] = quality.scaled(row, ratio)
    x[:, 30] = 1
    most = len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(40), 1 / np.linalg.norm(gram, 2)
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, most)
    assert np.allclose(w, (alpha * y) @ x, atol=1e-3)


def test_counts_of_spark(spark, monkeypatch):
    """Ratios from Spark's sparse counts are those of all rows that may be learnt from."""
    texts = {k: ("good plain words of prose " if k % 2 else "zz qq xx ## ") * (1 + k % 5) + str(k) for k in range(80)}
    labels = {k: k % 2 for k in texts if k < 70}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    _, ratio, _, _ = quality.train(docs, marks)
    learnt = {r.doc_id for r in marks.filter(~quality.held_out("doc_id")).collect()}
    counts = [Counter(), Counter()]
    for k in learnt:
        counts[labels[k]].update(quality.indicators(texts[k]).tolist())
    wide = [np.array([c[j] for j in range(quality.FEATURES)]) for c in counts]
    assert np.allclose(ratio, quality.log_count_ratio(wide[1], wide[0]))


def test_repeated_rows_and_names(spark):
    rows = [(1, "good words"), (1, "good words"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as held_out", "'p' as predicted", "1 as label", "2 as draw")
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 4)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality.judged(docs, marks).collect())
    assert len(got) == 4 and got[0] == got[1] and got[2][2] == got[3][2]
    assert quality.accepted(docs, marks).columns == docs.columns
