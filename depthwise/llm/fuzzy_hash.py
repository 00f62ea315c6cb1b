"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes sets chunk boundaries where it hits a fixed residue of the block size, so that an
edit moves only the boundaries next to it. Each chunk gives one letter; a fingerprint is `block size:letters:letters at twice
the block size`. The block size doubles with the text's length. Fingerprints compare at equal or neighbouring block sizes by
the edit distance of their letters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numtext import U64, as_bytes, inverse_powers, mix, prefix_polynomial
from .storage import materialize

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SMALLEST, MOST, ROLL = 3, 64, 7
#: Letters that two signatures must have in common in one run to be compared at all.
COMMON = 7


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each position (fewer at the start)."""
    n = len(data)
    total = np.zeros(n, np.uint32)
    padded = np.zeros(n + ROLL - 1, np.uint32)
    padded[ROLL - 1 :] = data
    for k in range(ROLL):
        total = total * np.uint32(0x01000193) + (padded[k : k + n] + np.uint32(1))
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return total ^ (total >> np.uint32(13))


def _signature(cut: np.ndarray, c: np.ndarray, inverse: np.ndarray, most: int) -> str:
    """Letters of the chunks that end before the positions `cut` and of the rest; the last letter of `most` takes all the rest."""
    n = len(c) - 1
    ends = cut[cut < n][: most - 1]
    start, end = np.append(0, ends), np.append(ends, n)
    h = mix((c[end] - c[start]) * inverse[start] + (end - start).astype(U64))
    return LETTERS[(h >> U64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; of a null or empty one `3::`."""
    data = as_bytes(text)
    n = len(data)
    if n == 0:
        return f"{SMALLEST}::"
    r, size = rolling(data), SMALLEST
    while size * MOST < n:
        size *= 2
    while True:
        at = np.flatnonzero(r % np.uint32(size) == size - 1) + 1
        if len(at) >= MOST // 2 or size == SMALLEST:
            break
        size //= 2
    c = prefix_polynomial(data)
    inverse = inverse_powers(n + 1)
    twice = at[r[at - 1] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{_signature(at, c, inverse, MOST)}:{_signature(twice, c, inverse, MOST // 2)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b, by the bit-parallel longest common subsequence."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON, len(a), len(b))
    if not run:
        return 0.0
    grams = {a[k : k + run] for k in range(len(a) - run + 1)}
    if not any(b[k : k + run] in grams for k in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 at block sizes that aren't equal or neighbours, else the better of the comparable
    signatures: 1 - edit distance / letters."""
    if x == y:
        return 1.0
    (p, a, aa), (q, b, bb) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_likeness(a, b), _likeness(aa, bb))
    if p == 2 * q:
        return _likeness(a, bb)
    if q == 2 * p:
        return _likeness(aa, b)
    return 0.0


def _row(doc, text, next_text):
    n = len(text)
    half = n // 2
    edited = text[: n - half] + next_text[:half]
    own, changed, following = fingerprint(text), fingerprint(edited), fingerprint(next_text)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, n, sha, own, changed, likeness(own, changed), likeness(own, following)


_SCHEMA = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _sorted_runs(batches):
    """Rows of a sorted partition -> results of all but its last row; its first and last rows themselves (edge = 0 and 1)."""
    k, held, first = TaskContext.get().partitionId(), None, None

    def out(rows, edges):
        n, m = len(rows), len(edges)
        columns = [pa.array([r[i] for r in rows] + [None] * m, t) for i, t in enumerate(_TYPES)]
        columns += [pa.array([None] * n + [e[i] for e in edges], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*_NAMES, "part", "edge", "edge_id", "edge_text"])

    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held is None:
                first = (k, 0, doc, text)
            else:
                rows.append(_row(*held, text))
            held = (doc, text)
        yield out(rows, [])
    if held is not None:
        yield out([], [first, (k, 1, *held)])


def _edge_rows(batches):
    for batch in batches:
        rows = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint and that of its edited text (the second half replaced by the start of the next document in
    order of id and text, after the last one the first), with likenesses.

    A null text counts as empty, a null id comes first, repeated ids follow each other by text; a single row is its own next;
    other columns are ignored. Texts move once, by ranges of the id; only the first and last row of each range moves again.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    runs = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(_sorted_runs, f"{_SCHEMA}, part int, edge int, edge_id bigint, edge_text string")
    runs = materialize(runs, "runs")
    edges = runs.filter("edge is not null").select("part", "edge", F.col("edge_id").alias("id"), F.col("edge_text").alias("text"))
    # one row for each range, so as few rows as there are partitions
    parts = edges.select("part").distinct().withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    last = edges.filter("edge = 1").join(parts, "part").select("id", "text", "next")
    first = edges.filter("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    closing = last.join(first, "next").select("id", "text", "next_text").mapInArrow(_edge_rows, _SCHEMA)
    return runs.filter("edge is null").select(*_NAMES).unionByName(closing).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text; a column of that name is replaced."""
    @F.pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint)

    return docs.withColumn(out_col, of(F.coalesce(F.col(text_col), F.lit(""))))
