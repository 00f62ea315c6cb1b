"""The similarity joins, decontamination and line deduplication against brute force."""

import re
from itertools import combinations

import numpy as np

from depthwise.llm import decontaminate, line_dedup, ngram_join
from depthwise.llm.numtext import U64

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_components(corpus):
    rows, df = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()}
    assert got == brute_components(rows)


def test_family_larger_than_a_block(spark, words, monkeypatch):
    """Many near copies that form chains, with blocks so small that the second round has pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = np.random.default_rng(4)
    base = list(r.choice(words, 120))
    rows = []
    for k in range(60):
        t = list(base)
        for i in r.choice(120, 1 + k % 5, replace=False):
            t[i] = str(r.choice(words))
        rows.append((k, " ".join(t)))
        if k % 10 == 0:
            base = t
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_components(df).collect()}
    assert got == brute_components(rows)


def test_one_of_each_stays(corpus):
    rows, df = corpus
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {v[1] for v in brute_components(rows).values()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], EMPTY)
    assert ngram_join.link_components(empty).collect() == []
    assert line_dedup.dedup_lines(empty).collect() == []
    assert decontaminate.benchmark_matches(empty, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_tree_bounds_keep_similar_pairs():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        s = r.integers(0, 1 << 63, int(r.integers(5, 300)), dtype=np.uint64)
        sets.append(np.unique(s))
        drop = r.random(len(s)) < 0.1
        sets.append(np.unique(np.where(drop, r.integers(0, 1 << 63, len(s), dtype=np.uint64), s)))
    sets.sort(key=len)
    tree = ngram_join.SignatureTree([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = set(zip(*(v.tolist() for v in tree.pairs(0.75))))
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if both >= 0.75 * (len(sets[a]) + len(sets[b]) - both):
            assert (a, b) in found
    assert len(found) < 200 and sets[0].dtype == U64


def brute_lines(rows, threshold=0.8):
    seen, out = [], {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            w = set(re.findall(r"[^ \t\x0b\x0c\r]+", line.lower()))
            gone = len(w) >= line_dedup.SHORTEST and any(len(w & v) >= threshold * len(w | v) - 1e-9 for v in seen)
            if len(w) >= line_dedup.SHORTEST:
                seen.append(w)
            if not gone:
                kept.append(line)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def test_lines(spark, corpus, words):
    rows, df = corpus
    r = np.random.default_rng(2)
    more = []
    for k in range(40):
        line = list(r.choice(words, 30, replace=False))
        near = [*line[:-1], "changed"]
        more.append((1000 + k, " ".join(line) + "\n" + " ".join(near[::-1]) + "\n" + " ".join(line[:15]), "en", "s", 1))
    all_rows = [tuple(x[:5]) for x in rows] + more
    both = df.unionByName(spark.createDataFrame(more, EMPTY), allowMissingColumns=True)
    got = line_dedup.dedup_lines(both)
    assert [c for c in got.columns if c not in ("n_lines", "n_removed")] == df.columns
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(all_rows)


def test_benchmark(spark, words):
    r = np.random.default_rng(8)
    items = [(k, " ".join(r.choice(words, 30 + k))) for k in range(20)] + [(90, "only three words"), (91, None), (92, " ".join(r.choice(words, 8)))]
    rows, wanted = [], set()
    for k in range(60):
        text = list(r.choice(words, 80))
        if k % 3 == 0:
            item = items[k % 20]
            passage = item[1].split(" ")
            for i in range(7, len(passage), 11):  # substitutions
                passage[i] = "other"
            text[20:20] = passage
            wanted.add((k, item[0]))
        rows.append((k, ", ".join(text).upper()))
    items.append((93, "Été à l’école «très» ÉLEVÉ " + " ".join(r.choice(words, 12))))
    rows += [(70, items[-2][1]), (71, None), (72, ""), (73, items[-1][1].upper().replace("’", " ").replace("«", "“"))]
    wanted.add((73, 93))
    wanted.add((70, 92))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as item", "1 as id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.benchmark_matches(df, bench).collect()} == wanted
    kept = decontaminate.without_matches(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in rows} - {d for d, _ in wanted}


def test_benchmark_in_blocks(spark, words, monkeypatch):
    r = np.random.default_rng(8)
    items = [(k, " ".join(r.choice(words, 30))) for k in range(10)]
    df = spark.createDataFrame([(k, "x " + t) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.benchmark_matches(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 70)
    assert sorted(decontaminate.benchmark_matches(df, bench).collect()) == whole and len(whole) == 10


def test_sets_that_share_a_key(corpus):
    """With keys of three bits many different sets share one; none are taken as equal for that."""
    rows, df = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df, key_bits=3).collect()}
    assert got == brute_components(rows)
