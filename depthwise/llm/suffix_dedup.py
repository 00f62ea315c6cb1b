"""Removal of byte strings that occur earlier in the corpus, by hash-compared suffix sorting.

Every repeated string of DEPTH bytes is caught, exactly. Each window of DEPTH bytes holds an anchor: its gram of GRAM bytes with
the lowest hash. Equal windows have equal anchors at equal places, so that occurrences need only be compared with those of the
same anchor, and anchors deal out the work:

- An exact copy of an earlier text is settled by its digest; only distinct texts go on.
- Occurrences of an anchor whose whole surroundings are equal are settled by a hash: all but the earliest are covered.
- The earliest ones of anchors with different surroundings are sorted, as suffixes from the anchor on and as reversed prefixes
  before it. Prefix polynomial hashes and binary search give the common extension of two suffixes in logarithmic time, a
  merge sort uses it to compare. What neighbours in the two orders have in common, verified on the bytes, tells which windows
  through the anchor are the same in which rows.
- An anchor of more than UNIT surroundings is split by the bytes next to it; where more than UNIT rows share these too, each of
  their windows is a row of its own and Spark finds the earliest of its digest, so that no task gathers more than two units.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numtext import BYTE_VALUES, U64, as_bytes, inverse_powers, mix, powers, prefix_polynomial, small
from .storage import bounded, materialize

DEPTH = 100
GRAM = 32
#: Bytes of a window beside its anchor.
AROUND = DEPTH - GRAM
#: Different surroundings of one anchor up to which they are one unit of work.
UNIT = 4096
#: Bound of a broadcast list of copies: 8 bytes each.
FEW_IDS = 1_000_000
#: Windows of a text that are looked at together; below 2**28.
STRETCH = 1 << 22
_POSITION = U64((1 << 28) - 1)


# ---- anchors -----------------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, hash of the surroundings) of the anchors of a text's windows; none below DEPTH bytes. Long texts go
    by stretches of windows, each with the bytes around it, as a place has 28 bits."""
    found = []
    for first in range(0, len(data) - DEPTH + 1, STRETCH):
        low = max(first - DEPTH, 0)
        gram, at, around = _anchors(data[low : first + STRETCH + 3 * DEPTH], first - low, STRETCH)
        found.append((gram, at + low, around))
    if len(found) == 1:
        return found[0]
    joined = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((U64, np.int64, U64))]
    once = np.append(True, joined[1][1:] != joined[1][:-1])[: len(joined[1])]  # windows on either side of an edge may share one
    return joined[0][once], joined[1][once], joined[2][once]


def _anchors(data: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors of the windows that start at `first` up to `first + most`."""
    n = len(data)
    c, inverse = prefix_polynomial(data), inverse_powers(n + 1)
    start = np.arange(n - GRAM + 1)
    gram = mix((c[GRAM:] - c[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    ranked = (gram & ~_POSITION) | start.astype(U64)  # of equal grams the leftmost
    width = AROUND + 1
    blocks = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, U64)
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - DEPTH + 1], ahead[AROUND : n - GRAM + 1])[first : first + most]
    at = (low[np.append(True, low[1:] != low[:-1])] & _POSITION).astype(np.int64)
    left, right = np.maximum(at - AROUND, 0), np.minimum(at + DEPTH, n)
    around = mix((c[right] - c[left]) * inverse[left] + ((at - left) * 1024 + right - at).astype(U64))
    return gram[at], at, around


def _anchor_rows(batches):
    for batch in batches:
        grams, ids, places, arounds = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g, at, around = anchors(as_bytes(text))
            grams.append(g)
            ids.append(np.full(len(g), doc, np.int64))
            places.append(at)
            arounds.append(around)
        if grams:
            columns = [np.concatenate(grams).view(np.int64), np.concatenate(ids), np.concatenate(places).astype(np.int32), np.concatenate(arounds).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "id", "at", "around"])


def _surroundings(batches):
    """(id, text, anchors) -> the bytes around each anchor. Anchors with many surroundings make a unit by the nearer half on
    either side each: two that match DEPTH bytes agree in one of them."""
    half = AROUND // 2
    for batch in small(batches):
        out = []
        for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            data = as_bytes(text).tobytes()
            for f in found:
                p, anchor = f["at"], f["anchor"]
                left = max(p - AROUND, 0)
                row = (doc, p, p - left, data[left : p + DEPTH], f["many"])
                if f["many"]:
                    for side, part in ((1, data[p - half : p] if p >= half else b""), (2, data[p + GRAM : p + GRAM + half])):
                        if len(part) == half:
                            out.append((int.from_bytes(hashlib.blake2b(part, digest_size=8, salt=bytes([side])).digest(), "little", signed=True) ^ anchor, *row))
                else:
                    out.append((anchor, *row))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["unit", "id", "at", "lead", "bytes", "many"])


def _windows(batches):
    """(id, at, begin, digest) of each window through the anchor of a row of surroundings."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            out = []
            for doc, at, lead, piece in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                for b in range(min(lead, len(piece) - DEPTH) + 1):
                    out.append((doc, at, at - lead + b, hashlib.blake2b(piece[b : b + DEPTH], digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], ["id", "at", "begin", "digest"])


# ---- suffix sort -------------------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of one buffer, each from `start` to at most `end`, that are compared by group first."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data = np.append(data, np.uint8(0))
        self.c = prefix_polynomial(data)
        self.inverse = inverse_powers(len(data) + 1)
        self.start, self.length, self.group = start, end - start, group

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        p, q = self.start[i], self.start[j]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.c[p + mid] - self.c[p]) * self.inverse[p] == (self.c[q + mid] - self.c[q]) * self.inverse[q]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def below(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones by their number."""
        out = self.group[i] < self.group[j]
        same = np.flatnonzero(self.group[i] == self.group[j])
        i, j = i[same], j[same]
        k = self.common(i, j)
        a, b = (np.where(k < self.length[x], self.data[np.minimum(self.start[x] + k, len(self.data) - 1)].astype(np.int64), -1) for x in (i, j))
        out[same] = np.where(a != b, a < b, i < j)
        return out

    def sorted(self) -> np.ndarray:
        """Merge sort, all merges of one width at once: an element's place is its own rank plus its rank in the other run."""
        order, n, width = np.arange(len(self.start)), len(self.start), 1
        widest = int(np.bincount(self.group).max(initial=1)) if n else 1
        while width < n:
            place = np.arange(n)
            run = place // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            first = low.copy()
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                less = self.below(order[mid], order[todo])
                low[todo], high[todo] = np.where(less, mid + 1, low[todo]), np.where(less, high[todo], mid)
            moved = np.empty_like(order)
            moved[(run & ~1) * width + place % width + low - first] = order
            order, width = moved, width * 2
            if width >= 2 * widest and (np.diff(self.group[order]) >= 0).all() and self._in_order(order):
                break
        return order

    def _in_order(self, order: np.ndarray) -> bool:
        return not len(order) or bool(self.below(order[:-1], order[1:]).all())

    def neighbours(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes, and how many bytes (up to `most`) each has in common with the one before it, 0 for the first
        of a group. The common bytes are verified; should hashes have lied, the bytes themselves are sorted."""
        order = self.sorted()
        i, j = order[:-1], order[1:]
        k = np.minimum(np.where(self.group[i] == self.group[j], self.common(i, j), 0), most)
        if not self._same(i, j, k):
            text = [(int(g), self.data[s : s + min(n, most)].tobytes()) for g, s, n in zip(self.group, self.start, self.length)]
            order = np.array(sorted(range(len(text)), key=text.__getitem__), np.int64)
            k = np.array([len(commonprefix([text[a][1], text[b][1]])) if text[a][0] == text[b][0] else 0 for a, b in zip(order[:-1], order[1:])], np.int64)
        return order, np.append(0, k)[: len(order)]

    def _same(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> bool:
        step = np.arange(int(k.max(initial=0)))
        for a in range(0, len(i), 20_000):
            p, q, n = (x[a : a + 20_000, None] for x in (self.start[i], self.start[j], k))
            top = len(self.data) - 1
            if not ((self.data[np.minimum(p + step, top)] == self.data[np.minimum(q + step, top)]) | (step >= n)).all():
                return False
        return True


def _classes(order: np.ndarray, k: np.ndarray, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For each of the rows and depths a number that two rows share if their suffixes agree so far: neighbours in suffix order do
    unless they have fewer bytes in common."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.empty((len(rows), len(depths)), np.int64)
    for j, depth in enumerate(depths):
        out[:, j] = np.cumsum(k < depth)[place[rows]]
    return out


def _best(order: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each suffix the most bytes that it has in common with another one of its group."""
    best = np.zeros(len(order), np.int64)
    best[order] = np.maximum(k, np.append(k[1:], 0)) if len(k) else k
    return best


def covered(group: np.ndarray, ids: np.ndarray, at: np.ndarray, lead: np.ndarray, pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(id, start, end) of what earlier occurrences cover: for rows of one anchor (group), the union of all windows through the
    anchor that occur earlier, which is one run. A window with b bytes before the anchor is the same in two rows if b bytes before
    it and the rest after it agree; the two suffix orders tell."""
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    start = end - size
    anchor, n = start + lead, len(data)
    right = Suffixes(data, anchor + GRAM, end, group).neighbours(AROUND)
    left = Suffixes(data[::-1].copy(), n - anchor, n - start, group).neighbours(AROUND)
    rows = np.flatnonzero(_best(*left) + _best(*right) >= AROUND)
    if not len(rows):
        return []
    before = np.arange(AROUND + 1)
    both = np.stack([_classes(*left, rows, before), _classes(*right, rows, AROUND - before)], axis=2)
    fits = (before <= lead[rows, None]) & (AROUND - before <= (size - lead)[rows, None] - GRAM)
    row, b = np.nonzero(fits)
    a, z = both[row, b, 0], both[row, b, 1]
    row = rows[row]
    order = np.lexsort((at[row], ids[row], z, a, b))
    x, y, w = a[order], z[order], b[order]
    head = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (w[1:] != w[:-1]))
    again = order[~head]
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
    begin = anchor[row[again]] - b[again]
    np.minimum.at(low, row[again], begin)
    np.maximum.at(high, row[again], begin + DEPTH)
    return [(int(ids[k]), int(at[k] + low[k] - anchor[k]), int(at[k] + high[k] - anchor[k])) for k in np.flatnonzero(high >= 0)]


def _covered_rows(batches):
    """Rows sorted by unit -> runs that earlier occurrences cover; whole units are gathered up to UNIT rows at a time."""

    def finish(rows):
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1].astype(np.int64)
        got = covered(group, *(np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3)), [r[4] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2))], ["id", "low", "high"])

    rows = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(rows) >= UNIT and rows[-1][0] != row[0]:
                yield finish(rows)
                rows = []
            rows.append(row)
    if rows:
        yield finish(rows)


# ---- on Spark ----------------------------------------------------------------------------------------------------------------


def without_runs(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """data without the union of the runs, and the number of maximal runs removed."""
    kept, at, spans, until = [], 0, 0, -1
    for low, high in sorted(runs):
        if low > until:
            kept.append(data[at:low])
            spans += 1
        until = at = max(until, high)
    kept.append(data[at:])
    return b"".join(kept), spans


def _kept_rows(batches):
    for batch in batches:
        out = []
        for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
            data = as_bytes(text).tobytes()
            kept, spans = without_runs(data, [(r["low"], r["high"]) for r in runs])
            out.append((doc, len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["id", "n_removed", "n_spans", "kept_sha256", "kept"])


def _hot_runs(rows: DataFrame) -> DataFrame:
    """(id, low, high) of what earlier occurrences cover, for rows of surroundings, by the digests of their windows."""
    windows = rows.select("id", "at", "lead", "bytes").dropDuplicates(["id", "at"]).mapInArrow(_windows, "id bigint, at int, begin int, digest binary")
    firsts = windows.groupBy("digest").agg(F.min(F.struct("id", "begin")).alias("first"), F.count("*").alias("cnt")).filter("cnt > 1").drop("cnt")
    again = windows.join(firsts, "digest").filter(F.struct("id", "begin") > F.col("first"))
    return again.groupBy("id", "at").agg(F.min("begin").alias("low"), (F.max("begin") + DEPTH).alias("high")).drop("at")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row: each byte is removed that a DEPTH-byte string covers which
    also starts earlier in the corpus (smaller id, or same text and earlier start). Strings are taken from the input.

    Null texts are empty; texts below DEPTH bytes stay whole. Ids should be unique integers: rows that share an id and a text are
    one document and have its result each; of texts that share an id the one with the lowest digest keeps the id's place, the
    others come where a hash of the id and the digest puts them. Rows with a null id come first. Other columns are ignored.
    """
    sha = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    names = docs.select(F.col(id_col).alias("name"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids = materialize(names.select("name", "id", sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes")), "ids")
    repeated = bounded(ids.groupBy("id").agg(F.count("*").alias("k"), F.min("sha").alias("lowest")).filter("k > 1").select("id", "lowest"), FEW_IDS, "repeated")
    if not repeated.isEmpty():
        place = F.when(F.col("lowest").isNull() | (F.col("sha") == F.col("lowest")), F.col("id")).otherwise(F.xxhash64("id", "sha"))
        ids = ids.join(repeated, "id", "left").withColumn("id", place).drop("lowest")
        texts = texts.withColumn("sha", sha).join(repeated, "id", "left").select(place.alias("id"), "text").dropDuplicates(["id"])
    firsts = ids.groupBy("sha").agg(F.min("id").alias("first"))
    ids = materialize(ids.join(firsts, "sha").withColumn("copy", (F.col("id") > F.col("first")) & (F.col("n_bytes") >= DEPTH)), "ids")
    copies = ids.filter("copy").select("id").distinct()
    own = texts.join(F.broadcast(copies) if copies.count() <= FEW_IDS else copies, "id", "left_anti")

    found = own.mapInArrow(_anchor_rows, "anchor bigint, id bigint, at int, around bigint").repartition("anchor")
    by_anchor = Window.partitionBy("anchor")
    kind = Window.partitionBy("anchor", "around").orderBy("id", "at")
    found = found.withColumn("nth", F.row_number().over(kind)).withColumn("cnt", F.count("*").over(by_anchor)).filter("cnt > 1")
    found = found.withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_anchor)).filter("nth > 1 or kinds > 1")
    found = materialize(found.select("anchor", "id", "at", "nth", "kinds"), "anchors")
    settled = found.filter("nth > 1").join(ids.select("id", "n_bytes").distinct(), "id").select("id", F.greatest(F.col("at") - AROUND, F.lit(0)).alias("low"), F.least(F.col("at") + DEPTH, F.col("n_bytes").cast("int")).alias("high"))

    # the texts are shuffled once for all surroundings, and once more for what is removed, if few only those that lose something
    mixed = found.filter("nth = 1 and kinds > 1").groupBy("id").agg(F.collect_list(F.struct("at", "anchor", (F.col("kinds") > UNIT).alias("many"))).alias("found"))
    around = own.join(mixed, "id").select("id", "text", "found").mapInArrow(_surroundings, "unit bigint, id bigint, at int, lead int, bytes binary, many boolean")
    around = materialize(around, "around")
    units, many, runs = around.drop("many"), around.filter("many").drop("many"), settled
    hot = bounded(many.groupBy("unit").count().filter(F.col("count") > UNIT).select("unit"), FEW_IDS, "hot")
    if not hot.isEmpty():
        units = around.join(hot.withColumn("many", F.lit(True)), ["unit", "many"], "left_anti").drop("many")
        runs = runs.unionByName(_hot_runs(many.join(hot, "unit", "left_semi")))
    runs = runs.unionByName(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_covered_rows, "id bigint, low int, high int"))
    runs = materialize(runs.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
    if runs.count() <= FEW_IDS:
        own = own.join(F.broadcast(runs.select("id")), "id", "left_semi")
    kept = own.join(runs, "id").select("id", "text", "runs").mapInArrow(_kept_rows, "id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").drop("kept")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    removed = F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    spans = F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint")
    sha = F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha"))
    return ids.join(kept, "id", "left").select(F.col("name").alias(id_col), "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), sha.alias("kept_sha256"))
