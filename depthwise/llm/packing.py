"""Packing of tokenised documents into windows by mixture-controlled deficit round-robin.

Each source is a queue of tokens. The windows are a row of slots of SLOT tokens; each slot goes to the queue that lags most
behind its target share, and what it is behind or ahead carries over to the next slot, window and partition. With constant
targets this order has a closed form: slot i of a queue with weight w is due at (2i + 1) / w, and slots are served by due
time. The place of a slot is therefore the number of slots due before it, a sum over the queues, and every task places its own
documents without knowing the others: the deficits never have to travel, although they are carried exactly. At any slot each
queue is less than one slot off its target. When a queue is empty the others go on in proportion. What is left of each queue
at the end (less than a slot each) closes up in the last windows, so only the very last window isn't full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numtext import small
from .storage import materialize
from .tokens import encoder

WINDOW = 1024
SLOT = 256
#: Sources with the most text that have queues of their own, beside all that `weights` names; the others share REST queues.
QUEUES, REST = 64, 16
#: Bound of the broadcast table of queue lengths by task: 24 bytes a row.
FEW_ROWS = 1_000_000
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokenised(path, names):
    queue_of = {name: k for k, name in enumerate(names)}

    def run(batches):
        enc, lane, so_far = encoder(path), TaskContext.get().partitionId(), {}
        for batch in small(batches):
            ids, queues, before, lengths = [], [], [], []
            for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                q = queue_of.get(source)
                if q is None:
                    q = len(names) + zlib.crc32(str(source).encode()) % REST
                x = enc.encode(text) + b"\0\0"
                ids.append(x)
                queues.append(q)
                before.append(so_far.get(q, 0))
                lengths.append(len(x) // 2)
                so_far[q] = before[-1] + lengths[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(queues, pa.int32()), pa.array([lane] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                ["id", "queue", "lane", "before", "n", "ids"],
            )

    return run


def slot_places(queue: int, slots: np.ndarray, counts: list[int], weights: list[int]) -> np.ndarray:
    """Place among all slots of slots `slots` of `queue`, if queue k has counts[k] slots and weight weights[k] > 0."""
    big = (2 * max(counts) + 2) * max(weights) >= 1 << 62
    i = slots.astype(object) if big else slots.astype(np.int64)
    place = i * 0
    w = weights[queue]
    for k, (count, other) in enumerate(zip(counts, weights)):
        if k == queue:
            place = place + i
        elif count:
            due = (2 * i + 1) * other - w  # 2 * w * j < due: slot j of queue k is due before
            place = place + np.clip(due // (2 * w) + 1 if k < queue else -(-due // (2 * w)), 0, count)
    return place.astype(np.int64)


def _pieces(counts, weights, totals, window, slot):
    slots = sum(counts)
    tails = np.concatenate([[0], np.cumsum([t - c * slot for t, c in zip(totals, counts)])]) + slots * slot

    def run(batches):
        for batch in batches:
            docs, queues, starts, ids = (c.to_pylist() for c in batch.columns)
            if not docs:
                continue
            lengths = [len(x) // 2 for x in ids]
            cuts = [np.arange(a // slot * slot, min(a + n, counts[q] * slot), slot, dtype=np.int64) for q, a, n in zip(queues, starts, lengths)]
            places: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
            for q in set(queues):  # all slots of a queue at once
                own = [k for k, v in enumerate(queues) if v == q]
                joined = slot_places(q, np.concatenate([cuts[k] for k in own]) // slot, counts, weights) * slot
                for k, part in zip(own, np.split(joined, np.cumsum([len(cuts[k]) for k in own])[:-1])):
                    places[k] = part
            begins, spots, pieces = [], [], []
            for q, start, n, cut, place in zip(queues, starts, lengths, cuts, places):
                full = counts[q] * slot
                begin = np.maximum(cut, start)
                place = place + begin - cut
                if start + n > full:  # the tail of the queue
                    at = max(start, full)
                    g = int(tails[q]) + at - full
                    more = np.unique(np.append(np.arange((g // window + 1) * window, g + start + n - at, window), g))
                    begin, place = np.append(begin, at + more - g), np.append(place, more)
                begins.append(begin - start)
                spots.append(place)
                pieces.append(len(begin))
            begin, place = np.concatenate(begins), np.concatenate(spots)
            n = np.repeat(lengths, pieces)
            last = np.cumsum(pieces) - 1
            length = np.append(begin[1:], 0) - begin
            length[last] = n[last] - begin[last]
            sums, at = [], 0
            for x, k in zip(ids, pieces):
                wide = memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes())
                sums += [zlib.crc32(wide[4 * i : 4 * (i + j)]) for i, j in zip(begin[at : at + k].tolist(), length[at : at + k].tolist())]
                at += k
            columns = [[d for d, k in zip(docs, pieces) for _ in range(k)], begin, length, sums, n, place // window, place % window]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None,
         window: int = WINDOW, slot: int = SLOT, ranks: str = RANKS) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and a closing id 0, so that null and empty texts have one token. `weights` gives the sources'
    target shares, each source that it names having a queue of its own, and other sources coming in as late as can be; by default
    the shares are those of the corpus, the QUEUES largest sources have queues of their own, and the others share some queues,
    packed at their joint share (name them in `weights` to keep them apart). A null source is a source of its own. sequence_id and offset depend on how the input is
    dealt to tasks: of one source, documents follow each other in the order of tasks and rows. Repeated rows are packed
    as often as they occur; an empty table gives no pieces; other columns are ignored. `ranks` is the path of the vocabulary.
    """
    if window % slot:
        raise ValueError("slot must divide window")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    largest = rows.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("size")).orderBy(F.desc("size"), "source").limit(QUEUES)
    names = list(weights or {})
    names += [r.source for r in largest.collect() if r.source not in names]
    tokens = materialize(rows.mapInArrow(_tokenised(ranks, names), "id bigint, queue int, lane int, before bigint, n bigint, ids binary"), "tokens")
    lanes = tokens.groupBy("queue", "lane").agg(F.sum("n").alias("n"))
    lanes = materialize(lanes.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("lane")) - F.col("n")), "lanes")
    by_queue = {r.queue: r.n for r in lanes.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    totals = [by_queue.get(q, 0) for q in range(len(names) + REST)]
    counts = [t // slot for t in totals]
    share = [max(c, 1) for c in counts]
    if weights:
        share = [max(1, round(1_000_000 * weights.get(name, 0))) for name in names] + [1] * REST
    base = lanes.select("queue", "lane", "base")
    placed = tokens.join(F.broadcast(base) if lanes.count() <= FEW_ROWS else base, ["queue", "lane"])
    placed = placed.select("id", "queue", (F.col("base") + F.col("before")).alias("start"), "ids")
    got = placed.mapInArrow(_pieces(counts, share, totals, window, slot), "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return got.withColumnRenamed("id", id_col)
