"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from depthwise.llm import spelling


def one_apart(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    letters = "abcdeéßÀÉñ÷"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 12))) for _ in range(40)]
    texts = []
    for k in range(400):
        words = []
        for _ in range(r.randint(0, 40)):
            w = base[min(r.randrange(40), r.randrange(40), r.randrange(40))]
            for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
                at, what = r.randrange(len(w)), r.choice("idr")
                w = w[:at] + (r.choice(letters) if what != "d" else "") + w[at + (what != "i") :]
            words.append(r.choice([w, w, w.upper() if w.isascii() else w]))
        texts.append(r.choice([" ", ", ", "1", "\n"]).join(words))
    texts += ["anagram", "anagram anargam", "AAAAAAA aaaaaaaa " * 30, "short words only", "", None, "y" * 50_000 + " " + "y" * 50_001, "y" * 50_000 + "-" + "y" * 50_001, "x" * 5_000 + "é" * 9]
    # chains: each ten times as frequent as the next
    texts += ["chainword " * 1200, "chainwort " * 110, "chaimwort " * 9]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "nullified nullified nullifieds nullifieds")]


def test_variants_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as n", "'s' as signature", "'x' as a").repartition(6)
    got = spelling.variants(docs).collect()
    assert len(got) == len({g.word for g in got})
    assert {tuple(g) for g in got} == plain(rows)


def test_every_near_pair_shares_a_signature():
    r = random.Random(4)
    for _ in range(1500):
        w = "".join(r.choice("abcé") for _ in range(r.randint(7, 14)))
        at, what = r.randrange(len(w)), r.choice("idr")
        x = w[:at] + (r.choice("abcdé") if what != "d" else "") + w[at + (what != "i") :]
        if not one_apart(w, x):
            continue
        a, b = sorted((w, x), key=len)
        index, longer, key = spelling.signatures([a, b])
        short = set(key[(index == 0) & ~longer].tolist())
        assert short & set(key[(index == 1) & (longer == (len(b) > len(a)))].tolist())


def test_words_are_counted_across_flushes(spark, monkeypatch):
    rows = [(k, f"alphabet betagamma {chr(97 + k % 26)}ddddddd") for k in range(60)]
    monkeypatch.setattr(spelling, "_FLUSH", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {tuple(g) for g in spelling.variants(docs).collect()} == plain(rows)


def test_no_words_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "once upon seldomness")], schema)).collect() == []
