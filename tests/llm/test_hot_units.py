"""Anchors and units of more than UNIT surroundings."""

import pytest

from depthwise.llm import suffix_dedup
from test_suffix_dedup import brute, corpus


@pytest.mark.parametrize("unit", [3, 12])
def test_hot_units(spark, monkeypatch, unit):
    """Units beyond the bound are not gathered in a task, and the result is whole."""
    monkeypatch.setattr(suffix_dedup, "UNIT", unit)
    split = []
    hot = suffix_dedup._hot_runs
    monkeypatch.setattr(suffix_dedup, "_hot_runs", lambda rows: split.append(rows.groupBy("unit").count().collect()) or hot(rows))
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert split[0] and all(r["count"] > unit for r in split[0])


def test_one_read_of_texts(spark, monkeypatch):
    """All surroundings come from one join with the texts, whether or not their anchors make several units."""
    monkeypatch.setattr(suffix_dedup, "UNIT", 3)
    written = []
    write = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: written.append(df) or write(df, name))
    last = suffix_dedup.remove_repeats(spark.createDataFrame(corpus(), "doc_id long, text string"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*written, last]]
    assert sum(p.count("_surroundings(") for p in plans) == 1
    assert plans[-1].count("LeftSemi") == 1
