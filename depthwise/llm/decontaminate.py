"""Benchmark passages in documents, found with spaced seeds.

A mask ignores some token positions of a run. For every mask, every run of a benchmark item is hashed over the positions that
count and put in a table; runs of the documents look themselves up. A hit fixes an alignment of the two texts, on which the
overlap is verified token by token, with substitutions allowed. The masks are chosen so that any overlap within the tolerance
has a hit, wherever its substitutions are.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import POSITION_FACTORS, PUNCTUATION, U64, as_bytes, mix, small, word_hashes
from .storage import bounded

#: Masks for one length of overlap at most, and positions that count in one.
MASKS, WEIGHT = 4, 9
#: Span of a mask at most.
SPAN = 32
#: Tokens of an overlap, and the share of them that must be equal.
OVERLAP, AGREEMENT = 16, 0.8
#: Items with fewer tokens aren't looked for unless asked: such short runs occur by chance.
SHORTEST = 5
#: Benchmark tokens that are broadcast at once; larger benchmarks go block by block.
BLOCK_TOKENS = 500_000
#: Bound of a broadcast list of document ids: 8 bytes each.
FEW_IDS = 1_000_000


#: Signs beyond ASCII that separate words.
_SIGNS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f]+")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of letters and digits."""
    return word_hashes(as_bytes(_SIGNS.sub(" ", (text or "").lower())), PUNCTUATION)


def substitutions(overlap: int, agreement: float) -> int:
    """Tokens of an overlap that may differ."""
    return max(k for k in range(overlap + 1) if overlap - k >= agreement * overlap or not k)


@lru_cache(None)
def covering_masks(overlap: int, substituted: int) -> tuple[str, ...]:
    """Masks (positions with 1 count) of which, for any `substituted` positions of an overlap, one has a place in the overlap
    where none of its own positions is among them. Of the heaviest weight at which few masks do, found greedily. An overlap with
    too many patterns to count is cut into equal parts, of which one has no more than its share of the substitutions: the masks
    of such a part do for the whole. Where few masks don't do, the run that is left between any substitutions.
    """
    parts = max(-(-overlap // 16), 1 if substituted <= 4 else -(-substituted // 4))
    if substituted and parts > 1 and overlap >= parts:
        return covering_masks(overlap // parts, substituted // parts)
    if overlap <= 16 and 0 < substituted <= 4:
        patterns = np.array([sum(1 << k for k in c) for c in combinations(range(overlap), substituted)])
        for weight in range(min(overlap - substituted, WEIGHT), 1, -1):
            masks = np.array([1 | sum(1 << k for k in c) for c in combinations(range(1, overlap), weight - 1)])
            hit = np.zeros((len(masks), len(patterns)), bool)
            for at in range(overlap):
                inside = (masks << at) < (1 << overlap)
                hit[inside] |= ((masks[inside, None] << at) & patterns) == 0
            chosen, left = [], np.ones(len(patterns), bool)
            while left.any() and len(chosen) <= MASKS:
                chosen.append(int((hit & left).sum(1).argmax()))
                left &= ~hit[chosen[-1]]
            if len(chosen) <= MASKS:
                return tuple(bin(masks[k])[:1:-1] for k in chosen)
    return ("1" * max(1, min(overlap // (substituted + 1), SPAN)),)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, int(mask, 2) + (len(mask) << 32), U64)
    for k in np.flatnonzero([c == "1" for c in mask]):
        total += words[k : k + n] * POSITION_FACTORS[k]
    return mix(total)


class SeedTable:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], overlap: int, agreement: float):
        self.overlap, self.agreement = overlap, agreement
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        # items that allow for as many substitutions share the masks of the shortest overlap among them, which cover longer ones
        needs = np.array([min(overlap, len(w)) for w in self.words], int)
        allowed = {n: substitutions(n, agreement) for n in set(needs.tolist())}
        users: dict[str, set[int]] = {}
        for k in sorted(set(allowed.values())):
            lengths = [n for n in allowed if allowed[n] == k]
            for group in [lengths] if k else [[n] for n in lengths]:  # without substitutions each length has a mask of its own
                for mask in covering_masks(min(group), k):
                    users.setdefault(mask, set()).update(group)
        found = []
        for mask, lengths in users.items():
            seeds = [(k, seed_hashes(w, mask)) for k, w in enumerate(self.words) if needs[k] in lengths]
            h = np.concatenate([s for _, s in seeds] or [np.zeros(0, U64)])
            item = np.concatenate([np.full(len(s), k) for k, s in seeds] or [np.zeros(0, int)])
            at = np.concatenate([np.arange(len(s)) for _, s in seeds] or [np.zeros(0, int)])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> U64(44)).astype(np.int64)] = True
            found.append((mask, h[order], item[order], at[order], seen))
        self.tables = found

    def matches(self, words: np.ndarray) -> dict[int, tuple[int, int]]:
        """item position -> (most equal tokens in an overlap, first token of it in the document)."""
        aligned = set()
        for mask, h, item, at, seen in self.tables:
            own = seed_hashes(words, mask)
            p = np.flatnonzero(seen[(own >> U64(44)).astype(np.int64)])
            left, right = np.searchsorted(h, own[p], "left"), np.searchsorted(h, own[p], "right")
            for i in np.flatnonzero(left < right):
                k = np.arange(left[i], right[i])
                aligned.update(zip(item[k].tolist(), (int(p[i]) - at[k]).tolist()))
        best: dict[int, tuple[int, int]] = {}
        for k, shift in sorted(aligned):
            w = self.words[k]
            low, high = max(0, -shift), min(len(w), len(words) - shift)
            need = min(self.overlap, len(w))
            if high - low < need:
                continue
            equal = np.concatenate([[0], np.cumsum(w[low:high] == words[low + shift : high + shift])])
            runs = equal[need:] - equal[:-need]
            top = int(runs.argmax())
            if runs[top] >= self.agreement * need and (int(equal[-1]), 0) > best.get(k, (-1, 0)):
                best[k] = (int(equal[-1]), low + shift + top)
        return best


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", overlap: int = OVERLAP, agreement: float = AGREEMENT, shortest: int = SHORTEST) -> DataFrame:
    """(id, item, matched, at): each pair of a document and a benchmark item of which it holds `overlap` aligned tokens (or all,
    of a shorter item), at least a share `agreement` of them equal. matched: equal tokens on the best alignment; at: first
    token of the overlap in the document.

    Tokens are runs of letters and digits, in lower case. Null or empty texts match nothing, nor do items of fewer than
    `shortest` tokens; with 1 every item with a token is looked for, those below five tokens without substitutions. Repeated rows give repeated results. Documents are never shuffled: a benchmark beyond BLOCK_TOKENS tokens is
    matched in blocks of items, each broadcast within that bound (a longer item is a block of its own).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    block, size, blocks = [], 0, []
    for r in items.toLocalIterator():
        w = tokens(r.text)
        if len(w) < max(1, shortest):
            continue
        if block and size + len(w) > BLOCK_TOKENS:
            blocks.append(spark.sparkContext.broadcast(SeedTable(block, overlap, agreement)))
            block, size = [], 0
        block.append((r.item, w))
        size += len(w)
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(SeedTable(block, overlap, agreement)))
    found = None
    for table in blocks:
        part = rows.mapInArrow(_matched(table), "id bigint, item bigint, matched bigint, at bigint")
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _matched(table):
    def run(batches):
        t = table.value
        for batch in small(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (matched, at) in t.matches(tokens(text)).items():
                    out.append((doc, t.ids[k], matched, at))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["id", "item", "matched", "at"])

    return run


def without_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows with a null id stay."""
    hits = benchmark_matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__hit")).distinct()
    hits = bounded(hits, FEW_IDS, "hits")
    return docs.join(hits, docs[id_col] == hits["__hit"], "left_anti")
