"""The trie of conversations against plain dictionaries, over shards of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from depthwise.llm import prefix_trie
from depthwise.llm.prefix_trie import Slots


def plain(rows, rebuild=True):
    """rows (conv_id, turn, role, text) -> the set of node rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, below = defaultdict(int), defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]] += 1
        for d in range(len(s) + 1):
            below[s[:d]].append(s)
    saved = lambda s: (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
    out = set()
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if seqs[c] == s)))
        out.add((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(not kids[x] for x in below[s]), sum(map(saved, below[s])), hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, rebuild=True, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'b' as base", "1 as size", "'p' as path", "2 as n", "3 as digest").repartition(5)
    c = df.conv_id
    paths = prefix_trie.conversation_paths(df, c - c % 5, prefix_trie.shared_turns) if rebuild else prefix_trie.conversation_paths(df)
    got = prefix_trie.trie(paths, **options).select(*COLUMNS).collect()
    out = {tuple(g) for g in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for c in range(300):
        if c % 7 == 6:
            continue  # bases that don't exist
        n = r.choice([1, 1, 2, 3, 5, 8, 12])
        kind = r.random()
        for t in range(n):
            if kind < 0.35:
                text = f"very common {t}"  # copies of one conversation, of several lengths
            elif kind < 0.6:
                text = "hello" if t == 0 else f"{r.randrange(3)} é{t}"
            else:
                text = f"{c} {t}"
            out.append((c, t if r.random() < 0.97 else None, None if r.random() < 0.03 else ("user", "assistant")[t % 2], None if r.random() < 0.03 else text))
    # at most one turn without a number each, so that their order is given
    seen, kept = set(), []
    for row in out:
        if (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            kept.append(row)
    r.shuffle(kept)
    return kept + [(None, 0, "user", "no conversation"), (1005, 0, "user", "x" * 100_000)]


@pytest.mark.parametrize("block", [1, 900, 200_000])
def test_nodes_equal_plain_ones_for_shards_of_any_size(spark, rows, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "PATHS", 3)
    assert found(spark, rows, block=block) == plain(rows)


def test_conversations_as_they_are_and_a_long_one(spark, rows):
    rows = rows + [(2000, t, "user", f"step {t}") for t in range(700)] + [(2001, t, "user", f"step {t}") for t in range(650)]
    assert found(spark, rows, rebuild=False, block=300) == plain(rows, rebuild=False)


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "own"), (c, 1, None, None)]
    assert found(spark, rows) == plain(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_repeated_rows_are_turns_of_their_own_and_ties_are_settled(spark):
    rows = [(7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "user", "b"), (8, 0, "user", "c"), (9, 0, "user", "c"), (9, 0, "user", "b")]
    got = found(spark, rows, rebuild=False)
    assert {(g[1], g[3]) for g in got} == {(0, 3), (1, 1), (2, 1), (1, 2), (2, 2)}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_slots_are_minimal_perfect_and_verified():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(r.integers(0, 1 << 63, (n, 2), dtype=np.uint64), axis=0)
        table = Slots(keys)
        slots = table(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        with pytest.raises(ValueError):
            table(r.integers(0, 1 << 63, (3, 2), dtype=np.uint64))
