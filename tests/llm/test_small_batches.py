"""Tasks take few texts apart at a time."""

import pyarrow as pa
import pytest

from depthwise.llm import ngram_join, packing, tokens
from depthwise.llm.numtext import TOGETHER


class Task:
    @staticmethod
    def get():
        return Task

    partitionId = staticmethod(lambda: 3)


def test_small_batches(monkeypatch):
    """A batch of many rows comes out in bounded pieces, in its order, with the queues' lengths carried on."""
    monkeypatch.setattr(packing, "TaskContext", Task)
    n = 2 * TOGETHER + 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["a", "b", None][k % 3] for k in range(n)), pa.array(None if k % 5 == 0 else "one two" for k in range(n))], ["id", "source", "text"])
    got = list(packing._tokenised(packing.RANKS, ["a", "b"])([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in got] == [TOGETHER, TOGETHER, 7]
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(n))
    so_far = {}
    for r in rows:
        assert r["before"] == so_far.get(r["queue"], 0) and len(r["ids"]) == 2 * r["n"]
        so_far[r["queue"]] = r["before"] + r["n"]


@pytest.mark.parametrize("rows", [TOGETHER + 1, 0])
def test_sets(rows):
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(["a b c d e f"] * rows, pa.string())], ["key", "text"])
    assert [b.num_rows for b in ngram_join._sets([batch])] == ([TOGETHER, 1] if rows else [])


def test_remembered(monkeypatch):
    """The memory of words is bounded, and words that it has lost get the same ids."""
    assert tokens.REMEMBERED <= 100_000
    encode = tokens.Encoder(packing.RANKS)
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    whole = encode.encode(text)
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    assert encode.encode(text + " once more").startswith(whole) and encode.encode(" zz" + text) and len(encode) <= 210
