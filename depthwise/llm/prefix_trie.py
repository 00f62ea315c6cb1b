"""Trie of conversations: what many of them begin with, and what storing each beginning once would save.

A node is a distinct sequence of first turns. Its digest is a chain: 16 bytes over the digest before it and that of the turn. A
conversation is then a path, the digests of its beginnings one after another, and paths in order of their bytes are the trie in
depth-first order. So the paths are dealt out by ranges, and each shard is a stretch of neighbours:

- In a shard the distinct prefix digests are enumerated and get slots by a minimal perfect hash: levels of bit arrays in which
  each digest that has a place to itself takes it, a slot being the number of places taken before. The table keeps the digest of
  each slot; a lookup compares it, and all that share a digest must agree on parent and depth.
- Counts are scattered into flat arrays by slot and accumulated through the array of parent slots, deepest nodes first.
- A node that isn't on the shard's first or last path lies in this shard alone and is done. The nodes of those two paths go on to
  the next round as two rows, with what the shard knows of each. Rounds shrink the rows a thousandfold until one shard is left.

How it scales: copies of one conversation, or all that share a first turn, are a range like any other and are split by id. A shard
holds BLOCK digests. No round depends on how deep the trie is. The ids that end at a node are hashed in its shard; at nodes of
several shards each shard writes its stretch of ids as one text, and the texts run through the hash one after another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numtext import U64, mix
from .storage import bounded, materialize

#: Digests of a shard, and the least number of paths in one.
BLOCK, PATHS = 200_000, 64
#: Bytes of a digest, and the root's.
WIDE = 16
ROOT = bytes(WIDE)
#: Bound of a broadcast table of nodes: 30 bytes each.
FEW_NODES = 1_000_000
_LAST = np.iinfo(np.int64).max
_SUMS = ("n", "children", "leaves", "saved")


# ---- paths of conversations --------------------------------------------------------------------------------------------------


def chained(before: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(before + turn, digest_size=WIDE).digest()


def _paths(shared: Callable[[int], int] | None):
    def run(batches):
        rows, held = [], 0
        head: list[tuple[bytes, int]] = []  # first turns of the family's first conversation
        family = conv = None
        path, sizes, k, h, last = bytearray(), [], 0, 0, ROOT

        def grow(turn, size):
            nonlocal last
            last = chained(last, turn)
            path.extend(last)
            sizes.append(size)

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["conv", "path", "sizes"])
            rows.clear()
            return out

        for batch in batches:
            for base, c, turn, size in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv or base != family:
                    if conv is not None:
                        rows.append((conv, bytes(path), np.array(sizes, np.int64).tobytes()))
                        held += len(path) + 64
                        if held > 1 << 22:
                            yield taken()
                            held = 0
                    if base != family:
                        family, head = base, []
                    conv, path, sizes, k, last = c, bytearray(), [], 0, ROOT
                    h = shared(c) if shared and c != base else 0
                    for x in head[:h]:
                        grow(*x)
                if c == base and shared and k < 8:
                    head.append((turn, size))
                if k >= h:
                    grow(turn, size)
                k += 1
        if conv is not None:
            rows.append((conv, bytes(path), np.array(sizes, np.int64).tobytes()))
        yield taken()

    return run


def conversation_paths(turns: DataFrame, base: Column | None = None, shared: Callable[[int], int] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, path, sizes): of each conversation the digests of its beginnings, and the UTF-8 bytes of each turn's text.

    Turns are in order of their number, null first; those of one number in order of their digests. Null roles and texts are empty.
    Rows without a conversation are left out. With `base` (the id of another conversation) and `shared`, the first shared(id) <= 8
    turns are those of the base instead. The texts themselves are not shuffled, only digests.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    conv = F.col(conv_col).cast("bigint")
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        (conv if base is None else base).alias("base"), conv.alias("conv"), F.col(turn_col).alias("turn"), F.substring(F.unhex(F.sha2(content, 256)), 1, WIDE).alias("digest"), F.octet_length(text).cast("bigint").alias("size")
    )
    ordered = rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest")
    return ordered.select("base", "conv", "digest", "size").mapInArrow(_paths(shared), "conv bigint, path binary, sizes binary")


def shared_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % 9


# ---- a shard -----------------------------------------------------------------------------------------------------------------


class Slots:
    """Minimal perfect hash of distinct digests (rows of two 64-bit words), which are kept by slot to be compared."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before, slot = np.arange(len(digests)), 0, np.empty(len(digests), np.int64)
        while len(left):
            size = max(64, len(left) * 5 // 4)
            at = self._at(digests[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            number = np.where(alone, before + np.cumsum(alone) - 1, -1)
            self.levels.append((number, alone))
            slot[left] = number[at]
            before += int(alone.sum())
            left = left[~alone[at]]
        self.digests = np.empty_like(digests)
        self.digests[slot] = digests

    @staticmethod
    def _at(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(digests[:, 0] + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)) ^ mix(digests[:, 1] + U64(level))) % U64(size)).astype(np.int64)

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        """Slots of digests that are all in the table; anything else is an error."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (number, alone) in enumerate(self.levels):
            at = self._at(digests[left], level, len(number))
            hit = alone[at]
            out[left[hit]] = number[at[hit]]
            left = left[~hit]
        if len(left) or not (self.digests[out] == digests).all():
            raise ValueError("a digest is not in the table")
        return out


class Shard:
    """The nodes of neighbouring paths in flat arrays. `rows`: (conv, path, sizes, sums), where sums is None for a conversation
    that ends with its path, else an array of first, n, children, leaves and saved for each depth of the path."""

    def __init__(self, rows: list[tuple], final: bool):
        width = np.array([len(r[1]) // WIDE + 1 for r in rows])
        words = np.frombuffer(b"".join(ROOT + r[1] for r in rows), U64).reshape(-1, 2)
        begin = np.cumsum(width) - width
        self.slots = Slots(np.unique(words, axis=0))
        slot = self.slots(words)
        count = len(self.slots.digests)
        depth = np.arange(len(words)) - np.repeat(begin, width)
        above = np.where(depth > 0, np.append(slot[:1], slot[:-1]), -1)
        size = np.concatenate([np.append(np.zeros(1, np.int64), np.frombuffer(r[2], np.int64)) for r in rows])
        self.parent, self.depth, self.size = (np.empty(count, np.int64) for _ in range(3))
        for mine, each in ((self.parent, above), (self.depth, depth), (self.size, size)):
            mine[slot] = each
            if not (mine[slot] == each).all():
                raise ValueError("two beginnings have one digest")
        self.slot, self.begin, self.width, self.end = slot, begin, width, slot[begin + width - 1]
        self.first = np.full(count, _LAST)
        self.n, self.children, self.leaves, self.saved = (np.zeros(count, np.int64) for _ in _SUMS)
        self.open = np.zeros(count, bool)
        if not final:
            for r in (0, len(rows) - 1):
                self.open[slot[begin[r] : begin[r] + width[r]]] = True
        plain = np.array([r[3] is None for r in rows])
        np.add.at(self.n, self.end[plain], 1)
        np.minimum.at(self.first, self.end[plain], np.array([r[0] for r in rows if r[3] is None], np.int64))
        for r in np.flatnonzero(~plain):
            at = slot[begin[r] : begin[r] + width[r]]
            first, *sums = np.frombuffer(rows[r][3], np.int64).reshape(5, -1)
            self.first[at] = np.minimum(self.first[at], first)
            for name, more in zip(_SUMS, sums):
                getattr(self, name)[at] += more
        self._accumulate()

    def _accumulate(self) -> None:
        order = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2))
        for low, high in zip(edges[-2::-1], edges[:0:-1]):
            s = order[low:high]
            s = s[~self.open[s]]
            self.leaves[s] = np.where(self.children[s] == 0, 1, self.leaves[s])
            self.saved[s] += (self.n[s] - 1) * self.size[s]
            s = s[self.parent[s] >= 0]
            p = self.parent[s]
            np.minimum.at(self.first, p, self.first[s])
            for name in ("n", "leaves", "saved"):
                np.add.at(getattr(self, name), p, getattr(self, name)[s])
            np.add.at(self.children, p, 1)

    def sums(self, row: int, given: np.ndarray) -> bytes:
        """What is known of the nodes of a path, zeros where it was given before."""
        at = self.slot[self.begin[row] : self.begin[row] + self.width[row]]
        out = np.stack([self.first[at], *(getattr(self, name)[at] for name in _SUMS)])
        out[:, given[at]] = np.array([_LAST, 0, 0, 0, 0])[:, None]
        given[at] = True
        return out.tobytes()


_SCHEMA = "kind string, digest binary, parent binary, parent_conv bigint, conv bigint, depth bigint, n bigint, children bigint, leaves bigint, saved bigint, text string, path binary, sizes binary, sums binary"
_KINDS = (pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), *[pa.binary()] * 3)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _finished(rows: list[tuple], final: bool) -> pa.RecordBatch:
    """Of one shard: a row (kind node) for each node that is done, two (path) for the next round, and (ends) for those of its nodes
    at which conversations of this shard end a text of their ids."""
    shard = Shard(rows, final)
    ending: dict[int, list[str]] = {}
    for r, slot in zip(rows, shard.end):
        if r[3] is None:
            ending.setdefault(int(slot), []).append(str(r[0]))
    digest = [d.tobytes() for d in shard.slots.digests]
    out = []
    for s in np.flatnonzero(~shard.open):
        p = int(shard.parent[s])
        known = p >= 0 and not shard.open[p]
        parent, parent_conv = (digest[p] if p >= 0 and not known else None), (int(shard.first[p]) if known else None)
        # of later rounds the texts come from the first
        text = None if rows[0][3] is not None else hashlib.sha256(",".join(ending.get(int(s), ())).encode()).hexdigest()
        out.append(("node", digest[s], parent, parent_conv, *(int(x[s]) for x in (shard.first, shard.depth, shard.n, shard.children, shard.leaves, shard.saved)), text, None, None, None))
    for s, ids in ending.items():
        if shard.open[s]:
            out.append(("ends", digest[s], None, None, int(ids[0]), *[None] * 5, ",".join(ids), None, None, None))
    if not final:
        given = np.zeros(len(digest), bool)
        for r in dict.fromkeys((0, len(rows) - 1)):
            out.append(("path", *[None] * 10, rows[r][1], rows[r][2], shard.sums(r, given)))
    return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(_KINDS)], _NAMES)


def _round(final: bool, block: int):
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not final and held >= block and len(rows) >= PATHS:
                    yield _finished(rows, final)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[1]) // WIDE + 1
        if rows:
            yield _finished(rows, final)

    return run


def _hashed(batches):
    """Rows (digest, text) in order -> the hash of each digest's texts, comma-joined."""
    digest = sha = None
    for batch in batches:
        out = []
        for d, text in zip(*(c.to_pylist() for c in batch.columns)):
            if d != digest:
                if digest is not None:
                    out.append((digest, sha.hexdigest()))
                digest, sha = d, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["digest", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["digest", "ends"])


def trie(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the paths
    (conv, path, sizes): its smallest member, that of the node above it, members, children, childless nodes below or at it, bytes
    saved at and below it, and the hash of the ids that end there. Without paths there are no nodes."""
    rows = materialize(paths, "paths").withColumn("sums", F.lit(None).cast("binary"))
    order, done, ends = ["path", "conv"], [], None
    while True:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "path", "sizes", "sums")
        found = materialize(rows.mapInArrow(_round(False, block), _SCHEMA), "nodes")
        ends = found.filter("kind = 'ends'") if ends is None else ends
        done.append(found.filter("kind = 'node'"))
        rows = found.filter("kind = 'path'").select("conv", "path", "sizes", "sums")
        size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("path") / WIDE + 1).alias("digests")).first()
        if size.n <= PATHS or size.digests <= block:
            break
    upper = rows.coalesce(1).sortWithinPartitions("path").mapInArrow(_round(True, block), _SCHEMA)  # within the size of a shard
    upper = materialize(upper, "nodes")
    for nodes in done[1:]:
        upper = upper.unionByName(nodes)
    texts = ends.select("digest", "conv", "text").repartition("digest").sortWithinPartitions("digest", "conv").select("digest", "text")
    hashes = texts.mapInArrow(_hashed, "digest binary, ends string")
    nothing = hashlib.sha256(b"").hexdigest()
    upper = materialize(upper.drop("text").join(hashes, "digest", "left").withColumn("text", F.coalesce("ends", F.lit(nothing))).drop("ends"), "upper")
    above = bounded(upper.select(F.col("digest").alias("parent"), F.col("conv").alias("above")), FEW_NODES, "above")
    out = done[0].unionByName(upper).join(above, "parent", "left")
    return out.select(
        "digest", F.col("conv").alias("conv_id"), "depth", F.coalesce("parent_conv", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("text").alias("ends_sha256"),
    )
