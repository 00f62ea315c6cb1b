"""Empty tables, repeated and null ids, and clashing column names of operators whose other tests have none of them."""

import hashlib

from depthwise.llm import fuzzy_hash, html_text, line_dedup, sharding

CLASH = ("1 as id", "'p' as part", "0 as edge", "'f' as fingerprint", "2 as n_chars", "3 as slot", "'s' as shard", "'u' as url")


def test_sharding(spark):
    shards = ["a", "b", "c"]
    assert sharding.place(spark.createDataFrame([], "doc_id long, more string"), "doc_id", shards).collect() == []
    rows = [(1,), (1,), (None,), (None,), (7,)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long").selectExpr("*", *CLASH), "doc_id", shards)
    assert got.columns.count("slot") == 1 and got.columns.count("shard") == 1
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, set()).add((r.slot, r.shard))
    assert all(len(v) == 1 for v in by_id.values()) and len(got.collect()) == 5


def plain_edits(rows):
    """(doc_id, n_chars, sha of the edited text) by sorting all rows in one list."""
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for k, (known, i, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][2], len(text) // 2
        out.append((i if known else None, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_fuzzy_hash_orders_repeated_and_null_ids(spark):
    rows = [(5, "five five five " * 20), (3, None), (5, "another five " * 30), (5, "five five five " * 20), (None, "no id " * 9), (9, ""), (1, "é" * 301), (None, None)]
    got = fuzzy_hash.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH[:4]).repartition(3))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()), key=str) == plain_edits(rows)
    assert fuzzy_hash.fingerprints_with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fuzzy_hash.fingerprints_with_edits(spark.createDataFrame([(1, "alone " * 30)], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(180, 1.0)]


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", "<p>Some text.</p>")] * 2 + [(None, None, None), (2, "v", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 as text", "'n' as n_chars", "1 as id"))
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=str) == sorted([(1, "u", "Some text.", 10)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)


def test_lines_of_repeated_ids_and_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a line of words\nanother line here"), (1, "a line of words\nsome third line now"), (2, "a line of words"), (None, "a line of words")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as no", "1 as n", "2 as pair", "3 as __id")).collect()}
    # lines at one place of rows with one id count as one and stay; the later document loses its line, the row without an id keeps it
    assert {t for d, t in got if d == 2} == {""} and (None, "a line of words") in got and len([1 for d, _ in got if d == 1]) == 2
