"""Exact duplicates against a plain grouping, and the summaries against exact counts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from depthwise.llm import exact_dedup


def plain(rows):
    """(doc_id, text) -> the rows that groups() gives, which of the rows with one id is kept aside."""
    texts = [(i, re.sub("[\x20\t-\r]+", " ", t or "")) for i, t in rows]
    members = defaultdict(list)
    for i, t in texts:
        members[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in members.items()}
    return Counter((i, keep[t], len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), len(members)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["a  b\tc", "a b c", "a\n\x0b\x0c\rb c", " a b c", "a b c ", "", None, "  ", "\n", "é x", "é  x", "x" * 200_000]
    texts += ["hot  text"] * 120 + ["warm"] * 40 + [f"rare {k}" for k in range(60)] + [f"rare {k} " for k in range(20)]
    out = [(k, t) for k, t in enumerate(texts)]
    r.shuffle(out)
    return out + [(3, "twice"), (3, "twice"), (None, "twice"), (None, "alone"), (None, "alone")]


@pytest.mark.parametrize("counters", [1, 2, 7, 1024])
def test_groups_equal_a_plain_grouping_whatever_is_heavy(spark, rows, counters):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'d' as digest", "0 as row", "9 as size", "'f' as first").repartition(5)
    got = exact_dedup.groups(docs, counters=counters).collect()
    expected, kept = plain(rows)
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == expected
    assert sum(g.kept for g in got) == kept and all(g.doc_id == g.keep_id for g in got if g.kept)


def test_heavy_hitters_hold_every_frequent_digest_within_the_bound(spark):
    r = random.Random(1)
    items = ["a"] * 300 + ["b"] * 150 + ["c"] * 90 + [f"u{k}" for k in range(700)]
    r.shuffle(items)
    df = spark.createDataFrame([(x.encode(),) for x in items], "digest binary").repartition(6)
    for k in (3, 10, 50):
        got = {row.digest.decode(): row.n for row in exact_dedup.heavy_hitters(df, counters=k).collect()}
        exact = Counter(items)
        assert len(got) <= k
        assert all(x in got for x, n in exact.items() if n * (k + 1) > len(items))
        assert all(exact[x] - len(items) / (k + 1) <= n <= exact[x] for x, n in got.items())


def test_unique_documents_keep_whole_rows_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id * 2 as more", "'s' as text_sha256").repartition(4)
    left = exact_dedup.unique_documents(docs)
    assert left.columns == docs.columns
    got = [tuple(x)[:3] for x in left.collect()]
    _, kept = plain(rows)
    assert len(got) == kept == len({re.sub("[\x20\t-\r]+", " ", t or "") for _, t, _ in got})
    assert (0 in {i for i, _, _ in got}) and all(more is None or more == 2 * i for i, _, more in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.groups(empty).collect() == [] and exact_dedup.unique_documents(empty).collect() == []
