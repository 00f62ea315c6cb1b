"""Benchmark matches against brute force over all alignments of token lists."""

import random

import pytest

from depthwise.llm import decontaminate


def plain(docs, items, overlap, agreement, shortest):
    """{(doc, item): (matched, at)} by trying every alignment; of alignments with as many equal tokens the leftmost of the document."""
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, t in items:
            w = (t or "").lower().split()
            need = min(overlap, len(w))
            if len(w) < max(1, shortest):
                continue
            best = None
            for shift in range(need - len(w), len(words) - need + 1):
                low, high = max(0, -shift), min(len(w), len(words) - shift)
                if high - low < need:
                    continue
                equal = [w[k] == words[k + shift] for k in range(low, high)]
                runs = [sum(equal[k : k + need]) for k in range(len(equal) - need + 1)]
                top = max(runs)
                if top >= agreement * need and (best is None or sum(equal) > best[0]):
                    best = sum(equal), low + shift + runs.index(top)
            if best:
                out[d, i] = best
    return out


def corpus(seed, n_docs=60, n_items=25):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 15, 16, 17, 30, 45])))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            w = items[r.randrange(n_items)][1].split()
            a = r.randrange(len(w))
            piece = [x if r.random() > 0.12 else "other" for x in w[a if r.random() < 0.3 else 0 :]]
            at = r.randint(0, len(words))
            words[at:at] = piece
        docs.append((k, " ".join(words)))
    return docs + [(900, None), (901, ""), (docs[3][0], docs[3][1])], items + [(800, None), (801, " ")]


@pytest.mark.parametrize("overlap,agreement,shortest", [(16, 0.8, 5), (16, 0.8, 1), (20, 0.8, 1), (33, 0.75, 5), (8, 1.0, 1), (40, 0.7, 3)])
def test_matches_equal_brute_force(spark, overlap, agreement, shortest):
    docs, items = corpus(overlap)
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as matched").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.benchmark_matches(left, right, overlap=overlap, agreement=agreement, shortest=shortest).collect()
    got = {(r.doc_id, r.item_id): (r.matched, r["at"]) for r in rows}
    want = plain(docs, items, overlap, agreement, shortest)
    assert set(got) == set(want) and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want
    assert len(rows) == len(got) + sum(k[0] == docs[3][0] for k in got)  # the repeated row has its results again


@pytest.mark.parametrize("overlap,substituted", [(20, 4), (33, 8), (48, 9), (17, 3), (16, 5), (40, 12)])
def test_masks_of_long_overlaps_leave_no_random_pattern_out(overlap, substituted):
    r = random.Random(overlap)
    masks = decontaminate.covering_masks(overlap, substituted)
    assert len(masks) <= decontaminate.MASKS
    for _ in range(3000):
        gone = set(r.sample(range(overlap), substituted))
        assert any(all(m == "0" or at + k not in gone for k, m in enumerate(mask)) for mask in masks for at in range(overlap - len(mask) + 1))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.benchmark_matches(docs, items).collect() == [] == decontaminate.benchmark_matches(full, items).collect()
    assert decontaminate.without_matches(full, items).count() == 1
