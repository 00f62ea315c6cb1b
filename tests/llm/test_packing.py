import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depthwise.llm.packing import pack, slot_places

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows():
    texts = ["The thing's  over-there; don't 12,345 naïve “quoted” ½ 東京  x", "", None, "a" * 700, "mot été_là\t\n\n  fin ", "été " * 3000, "x <|endoftext|> y<|endoftext|>"]
    out = [(k, texts[k % len(texts)], f"s{k % 3}" if k % 7 else None) for k in range(60)]
    return out + [(60 + k, "word " * (10 + k), "hot") for k in range(200)] + [(5, "repeated row", "s1")] * 2


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as queue", "'x' as n").repartition(3)
    got = pack(df).collect()
    wanted = sorted((d, zlib.crc32(np.array(ids(t), "<u4").tobytes()), len(ids(t))) for d, t, _ in rows() if d != 5)
    by_doc = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        if r.doc_id != 5:
            by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    texts = {d: t for d, t, _ in rows()}
    for doc, pieces in by_doc.items():
        all_ids, at = ids(texts[doc]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(all_ids)
            assert r.ids_crc32 == zlib.crc32(np.array(all_ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(all_ids)
    assert {d for d, _, _ in wanted} == set(by_doc)
    for sequence, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or sequence == max(windows)
    total = sum(len(ids(t)) for _, t, _ in rows())
    assert max(windows) == (total - 1) // 1024 and sum(n for p in windows.values() for _, n in p) == total


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


@pytest.mark.parametrize("weights", [[5, 3, 7], [1, 1, 10], [4, 9, 1]])
def test_places_follow_the_targets(weights):
    counts = [500, 300, 700]
    places = [slot_places(k, np.arange(counts[k]), counts, weights) for k in range(3)]
    assert sorted(np.concatenate(places).tolist()) == list(range(1500))
    order = np.empty(1500, int)
    for k, p in enumerate(places):
        order[p] = k
    until = min(c / w for c, w in zip(counts, weights)) * sum(weights) - 2
    for at in range(1, int(until)):
        for k in range(3):
            assert abs((order[:at] == k).sum() - at * weights[k] / sum(weights)) <= 1.0 + 1e-9


def test_weights_of_many_sources(spark):
    """Every source that has a weight is held to it, beyond the number of queues for others too."""
    sources, each = 90, 4 * 1024
    weights = {f"s{k}": 1 + k % 3 for k in range(sources)}
    rows = [(k, "a " * each, f"s{k}") for k in range(sources)] + [(900, "b " * 100, "unnamed")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), weights=weights).collect()
    place = sorted((r.sequence_id * 1024 + r.offset, r.doc_id, r.length) for r in got)
    until, taken = sum(weights.values()) * 256 * 4, defaultdict(int)
    for at, doc, length in place:
        if at < until:
            taken[doc] += min(length, until - at)
    for k in range(sources):
        assert abs(taken[k] - weights[f"s{k}"] * 256 * 4) <= 256
    assert taken[900] == 0


def test_places_of_huge_counts():
    """Beyond 64 bits: the same places by exact arithmetic."""
    counts, weights = [1 << 40, 3, 1 << 41], [1 << 30, 7, 1 << 31]
    slots = [0, 1, 2, 1 << 20, (1 << 40) - 1]
    for i, place in zip(slots, slot_places(0, np.array(slots), counts, weights).tolist()):
        before = i
        for k in (1, 2):
            due = (2 * i + 1) * weights[k] - weights[0]
            before += min(max(-(-due // (2 * weights[0])), 0), counts[k])
        assert place == before
