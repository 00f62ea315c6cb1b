"""Repeated lines of one word."""

from depthwise.llm import line_dedup
from test_joins import EMPTY


def test_one_word_lines(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(["Menu\none two", "menu\n----\n\n ", "x\n----\nmenu menu", "", "MENU\n\ny"])]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == {0: "Menu\none two", 1: "----\n\n ", 2: "x", 3: "", 4: "\ny"}
