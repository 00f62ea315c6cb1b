import hashlib
import random

from depthwise.llm.suffix_dedup import DEPTH, Suffixes, remove_repeats

import numpy as np


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for i in range(len(data) - DEPTH + 1):
            w = data[i : i + DEPTH]
            if w in seen:
                hit[i : i + DEPTH] = b"\1" * DEPTH
            seen.add(w)
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[doc] = (len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(4)] + ["x" * 500, "ab" * 150]
    rows = [(k, text(r.randint(0, 60)) + r.choice(passages)[r.randint(0, 40) : r.randint(60, 260)] + text(r.randint(0, 30)) + r.choice(passages)) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, None), (201, ""), (202, "short"), (203, "short"), (204, "z" * 5000)]
    return rows


def test_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as anchor")
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(df).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_sort():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(400))
    start = np.arange(0, 380)
    end = np.minimum(start + 30, 400)
    group = start % 3
    order = Suffixes(np.frombuffer(data, np.uint8), start, end, group).sorted()
    assert order.tolist() == sorted(range(380), key=lambda i: (i % 3, data[i : min(i + 30, 400)], i))
