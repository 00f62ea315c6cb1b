"""Exact Jaccard join of documents on word shingles, by signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches `threshold`. Two linked sets share a shingle
among their first n - ceil(threshold * n) + 1 ones, in any order common to all sets (prefix filter). So sets meet in the
groups of their prefix shingles, and each group is joined by a signature tree: documents are the leaves, an inner node holds
the OR of the token bitmaps and the range of the set sizes below it, and a dual traversal drops the pairs of nodes whose
largest possible overlap is too small. What reaches the leaves is verified on the full sets.

How it scales:

- Equal sets are one member (their 64-bit key), so a group of copies costs one member. That sets of one key are equal is checked
  by 64 bits of their SHA-256 too; sets that share a key but aren't equal (two or three pairs are to be expected among ten thousand
  million sets, so their list comes to the driver) go by those bits instead.
- Frequent shingles come last in the order, so that they seldom are in a prefix. Their list has at most HOT_SHINGLES entries
  and only changes the order, never the result.
- A group is split by classes of set sizes; what shares a shingle with no set of a similar size goes no further.
- Trees hold bitmaps (a few bits for each shingle); full sets move only for the pairs that the bounds leave.
- First round: each member is tried against the pivots of two of its groups, the largest and the one whose list of members
  recurs most. A pivot is the member that shares most with others, so that the original of a family of near copies is tried
  against all of them. Large families get connected here, at linear cost.
- Second round: only groups that still hold several components; a task unit is a group of at most BLOCK members, or a pair of
  blocks of a larger one. Node pairs inside one component are skipped, and pairs that meet in a group of a lower shingle too,
  as far as the first HEAD shared shingles of each member tell.
- Components of what is linked come from large-star and small-star rounds on a written table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numtext import U64, set_key, shingle_set, small
from .storage import bounded, materialize

WORDS = 5
THRESHOLD = 0.75
BLOCK = 256
#: Bound of the broadcast list of frequent shingles: 8 bytes each.
HOT_SHINGLES = 65_536
#: Bound of a broadcast list of document ids: 8 bytes each.
FEW_IDS = 1_000_000
_FLUSH = 2_000_000
#: Shared shingles of a member, the lowest, that travel with it.
HEAD = 12


# ---- sets of documents -------------------------------------------------------------------------------------------------


def bitmap(s: np.ndarray) -> np.ndarray:
    """Token bitmap of a set: two to four bits for each element, from 256 to 65,536 bits, as 64-bit words."""
    size = 1 << min(16, max(8, (2 * len(s) - 1).bit_length() if len(s) else 8))
    flags = np.zeros(size, bool)
    flags[((s >> U64(40)) & U64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(U64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at a smaller size."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _check(s: np.ndarray) -> int:
    """64 bits of the SHA-256 of a set, next to its key."""
    return int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:8], "little", signed=True)


def _name(s: np.ndarray, bits: int, mixed: frozenset[int]) -> int:
    """The key of a set; of one whose key other sets have too (mixed), its check."""
    key = set_key(s) >> (64 - bits)
    return _check(s) if key in mixed else key


def _profiles(key_bits):
    """(id, n, key, check) of every document, and the shingles that are frequent within this task's run of documents."""

    def run(batches):
        yield from _profiled(batches, key_bits)

    return run


def _profiled(batches, key_bits):
    held, size = [], 0

    def frequent():
        if not held:
            return None
        shingle, hits = np.unique(np.concatenate(held), return_counts=True)
        keep = hits >= 8
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(shingle[keep].view(np.int64)), pa.array(hits[keep].astype(np.int64))],
            ["id", "n", "key", "check", "bits", "hot", "hits"],
        )

    for batch in small(batches):
        sizes, keys, checks, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, WORDS)
            sizes.append(len(s))
            bits.append(bitmap(s).tobytes())
            keys.append(_name(s, key_bits, frozenset()) if len(s) else None)
            checks.append(_check(s))
            held.append(s)
            size += len(s)
            if size > _FLUSH:
                yield frequent()
                held, size = [], 0
        k = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
            ["id", "n", "key", "check", "bits", "hot", "hits"],
        )
    if (rest := frequent()) is not None:
        yield rest


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def _prefixes(hot_list, threshold, key_bits, mixed):
    def run(batches):
        hot, seen = hot_list.value, set()
        for batch in small(batches):
            shingles, keys, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, WORDS)
                n = len(s)
                if not n or (key := _name(s, key_bits, mixed)) in seen:
                    continue
                seen.add(key)
                common = np.zeros(n, bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    common = hot[at] == s
                p = np.concatenate([s[~common], s[common]])[: prefix_length(n, threshold)]
                shingles.append(p)
                keys.append(np.full(len(p), key, np.int64))
                sizes.append(np.full(len(p), n, np.int32))
            if shingles:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["s", "key", "n"]
                )

    return run


def _sets(batches):
    for batch in small(batches):
        sets = [shingle_set(text, WORDS) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "members"])


# ---- the signature tree of one unit --------------------------------------------------------------------------------------


class SignatureTree:
    """Nodes level by level, leaves first, in the order given. A node: OR of the bitmaps, smallest and largest set, largest
    excess (set size less bits set), and the component if all leaves below share one (else -1)."""

    FAN = 8

    def __init__(self, bitmaps: list[np.ndarray], sizes: np.ndarray, component: np.ndarray):
        words = min(map(len, bitmaps))
        bm = np.stack([folded(b, words) for b in bitmaps])
        n = sizes.astype(np.int64)
        self.levels = [(bm, n, n, n - np.bitwise_count(bm).sum(1).astype(np.int64), component)]
        while len(self.levels[-1][1]) > 1:
            bm, low, high, excess, comp = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            lo, hi = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(bm, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(lo == hi, lo, -1)))

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs x < y of leaves of different components that the bounds at no level exclude: the sizes must be compatible, and
        bits in common plus the smaller excess bound the overlap."""
        x = y = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            bm, low, high, excess, comp = self.levels[level]
            if level < len(self.levels) - 1:
                f = np.arange(self.FAN)
                x, y = (np.broadcast_to(v[:, None, None] * self.FAN + k, (len(v), self.FAN, self.FAN)).ravel() for v, k in ((x, f[:, None]), (y, f[None, :])))
                fits = (x <= y) & (x < len(low)) & (y < len(low))
                x, y = x[fits], y[fits]
            if level == 0:
                x, y = x[x < y], y[x < y]
            keep = (np.maximum(low[x], low[y]) * threshold <= np.minimum(high[x], high[y]) + 1e-9) & ((comp[x] != comp[y]) | (comp[x] < 0))
            x, y = x[keep], y[keep]
            need = np.ceil((low[x] + low[y]) * (threshold / (1 + threshold)) - 1e-9)
            keep = np.zeros(len(x), bool)
            for i in range(0, len(x), 4096):
                p, q = x[i : i + 4096], y[i : i + 4096]
                keep[i : i + 4096] = np.bitwise_count(bm[p] & bm[q]).sum(1) + np.minimum(excess[p], excess[q]) >= need[i : i + 4096]
            x, y = x[keep], y[keep]
        return x, y


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold, in whole numbers."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 10_000 * both >= round(10_000 * threshold) * (len(a) + len(b) - both)


def _pivot_pairs(threshold):
    """(a, na, bits a, b, nb, bits b) -> the pairs (a, b) that a tree of the two leaves doesn't exclude."""

    def run(batches):
        for batch in batches:
            out = []
            for a, na, x, b, nb, y in zip(*(c.to_pylist() for c in batch.columns)):
                tree = SignatureTree([np.frombuffer(x, U64), np.frombuffer(y, U64)], np.array([na, nb]), np.arange(2))
                if len(tree.pairs(threshold)[0]):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _tree_pairs(threshold):
    """Rows (unit, s, key, n, bits, comp, head) sorted by unit -> the pairs (a, b) of keys that the unit's tree doesn't exclude,
    unless both have a shingle below s in their heads and so meet in its unit, too."""

    def finish(rows):
        rows.sort(key=lambda r: (r[2], r[1]))
        comp = np.unique([r[4] for r in rows], return_inverse=True)[1].astype(np.int64)
        tree = SignatureTree([np.frombuffer(r[3], U64) for r in rows], np.array([r[2] for r in rows]), comp)
        keys = np.array([r[1] for r in rows], np.int64)
        head = np.full((len(rows), HEAD), np.iinfo(np.int64).max)
        for k, r in enumerate(rows):
            lower = [v for v in r[5] if v < r[0]]
            head[k, : len(lower)] = lower
        x, y = tree.pairs(threshold)
        new = np.ones(len(x), bool)
        for i in range(0, len(x), 4096):
            p, q = head[x[i : i + 4096]], head[y[i : i + 4096]]
            new[i : i + 4096] = ~((p[:, :, None] == q[:, None, :]) & (p[:, :, None] < np.iinfo(np.int64).max)).any((1, 2))
        x, y = x[new], y[new]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[x], keys[y])), pa.array(np.maximum(keys[x], keys[y]))], ["a", "b"])

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            for u, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit:
                    if len(rows) > 1:
                        yield finish(rows)
                    unit, rows = u, []
                rows.append(row)
        if len(rows) > 1:
            yield finish(rows)

    return run


def _verified(threshold):
    def run(batches):
        for batch in small(batches):
            a, x, b, y = (c.to_pylist() for c in batch.columns)
            ok = [similar(np.frombuffer(p, U64), np.frombuffer(q, U64), threshold) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, ok) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


# ---- components ------------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp) with the smallest node of each component, by large-star and small-star rounds.

    Each round is written out, so lineage and a lost executor cost one round at most. Only a count comes to the driver.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.min("b").over(Window.partitionBy("a"))
        large = both.withColumn("m", F.least(low, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) in (before, (0, None)):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
        before = tuple(now)


# ---- the join ----------------------------------------------------------------------------------------------------------------


def _keys(found: DataFrame) -> DataFrame:
    """(key, id, low, high) of each set: the smallest id that has it, and the range of the checks, which are equal unless different
    sets share the key."""
    return found.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, key_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id that links reach.

    Null and empty texts and texts of white space have no shingles and link with nothing. Rows with equal sets link. Repeated
    ids give repeated rows. Other columns are ignored. The ids must be integers. `key_bits` is the length of the keys of sets;
    the result doesn't depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = materialize(rows.mapInArrow(_profiles(key_bits), "id bigint, n int, key bigint, check bigint, bits binary, hot bigint, hits bigint"), "profiles")
    keys = materialize(_keys(found), "keys")
    mixed = frozenset(r.key for r in keys.filter("low <> high").select("key").toLocalIterator())
    if mixed:
        found = found.withColumn("key", F.when(F.col("key").isin(*mixed), F.col("check")).otherwise(F.col("key")))
        keys = materialize(_keys(found), "keys")
    keys = keys.select("key", "id")
    profiles = found.filter("hot is null").select("id", "n", "key")
    bits = found.filter("key is not null").join(keys, ["id", "key"]).select("key", "n", "bits").dropDuplicates(["key"])
    hot = found.filter("hot is not null").groupBy("hot").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "hot").limit(HOT_SHINGLES)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.hot for r in hot.collect()], np.int64).view(U64)))

    # units (s, class): the sets of a size class with those of the next one, for each shared prefix shingle
    prefix = rows.select("text").mapInArrow(_prefixes(hot, threshold, key_bits, mixed), "s bigint, key bigint, n int").repartition("s").dropDuplicates(["s", "key"])
    own = F.floor(F.log("n") / math.log(1 / threshold)).cast("int")
    shared = prefix.withColumn("cnt", F.count("*").over(Window.partitionBy("s"))).filter("cnt > 1")
    unit = Window.partitionBy("s", "class")
    shared = shared.withColumn("own", own).withColumn("class", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    shared = shared.withColumn("cnt", F.count("*").over(unit)).withColumn("owned", F.max(F.col("own") == F.col("class")).over(unit))
    shared = materialize(shared.filter("cnt > 1 and owned").select("s", "class", "key", "n", "cnt"), "shared")

    pivots = _first_round(shared, bits, threshold)
    links = _links(rows, keys, pivots, threshold)
    label = components(links)
    candidates = _second_round(shared, bits, label, threshold)
    links = links.unionByName(_links(rows, keys, candidates, threshold))
    merged = components(links)
    named = keys.join(merged.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("comp", "key").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "comp").select("key", "component_id")
    return profiles.join(named, "key", "left").select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _links(rows: DataFrame, keys: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose full sets are similar. A set comes from the document with the smallest id that has it."""
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = bounded(keys.join(wanted, "key", "left_semi").select("id", "key"), FEW_IDS, "ids")
    texts = rows.join(ids, "id").select("key", "text")
    sets = texts.mapInArrow(_sets, "key bigint, members binary").dropDuplicates(["key"])
    a, b = (sets.select(F.col("key").alias(k), F.col("members").alias(f"set_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "set_a", "b", "set_b")
    return materialize(both.mapInArrow(_verified(threshold), "a bigint, b bigint"), "links")


def _first_round(shared: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """Each member with the pivots of two of its units."""
    lists = shared.withColumn("list", F.bit_xor("key").over(Window.partitionBy("s", "class")))
    recurs = lists.groupBy("key", "list").agg(F.count("*").alias("times"), F.max("cnt").alias("cnt"), F.sum("cnt").alias("all"), F.first("n").alias("n"), F.max_by(F.struct("s", "class"), F.struct("cnt", "s", "class")).alias("u"))
    chosen = recurs.groupBy("key").agg(F.first("n").alias("n"), F.sum("all").alias("rank"), F.max_by("u", F.struct("cnt", "u")).alias("large"), F.max_by("list", F.struct("times", "cnt", "list")).alias("often"))
    chosen = materialize(chosen, "chosen")
    found = None
    for group in ("large", "often"):
        # summed up before the shuffle, so that a large group is not one task's
        pivots = chosen.groupBy(group).agg(F.max_by("key", F.struct("rank", F.negative("n"), F.bitwise_not("key"))).alias("pivot"))
        part = chosen.join(pivots, group).select("key", "pivot").filter("key <> pivot")
        found = part if found is None else found.unionByName(part)
    a, b = (bits.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("pivot", "key"))
    both = found.distinct().join(a, "pivot").join(b, "key").select("pivot", "n_pivot", "bits_pivot", "key", "n_key", "bits_key")
    return both.mapInArrow(_pivot_pairs(threshold), "a bigint, b bigint")


def _second_round(shared: DataFrame, bits: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """Pairs of keys of different components that the trees of their units don't exclude."""
    unit = Window.partitionBy("s", "class")
    named = shared.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    members = named.withColumn("lo", F.min("comp").over(unit)).withColumn("hi", F.max("comp").over(unit)).filter("lo <> hi")
    members = materialize(members.select("s", "class", "key", "n", "comp", "cnt"), "members")
    # units of one block: equal lists of members are one unit
    small = members.filter(F.col("cnt") <= BLOCK).groupBy("s", "class").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    small = small.groupBy(F.xxhash64("keys").alias("unit")).agg(F.first("keys").alias("keys"), F.min("s").alias("s")).select("unit", "s", F.explode("keys").alias("key"))
    # larger ones: blocks by size, and pairs of blocks whose sizes are compatible and that aren't one component
    block = F.expr(f"cast((row_number() over (partition by s, class order by n, key) - 1) div {BLOCK // 2} as int)")
    ranked = materialize(members.filter(F.col("cnt") > BLOCK).withColumn("block", block), "ranked")
    blocks = ranked.groupBy("s", "class", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.low") * threshold <= F.col("a.high")) & ~((F.col("a.c0") == F.col("b.c1")) & (F.col("a.c1") == F.col("b.c0"))))
    pairs = pairs.select("a.s", "a.class", F.xxhash64("a.s", "a.class", "a.block", "b.block").alias("unit"), F.explode(F.array_distinct(F.array("a.block", "b.block"))).alias("block"))
    large = ranked.join(pairs, ["s", "class", "block"]).select("unit", "s", "key")
    comps = label.withColumnRenamed("node", "key")
    heads = members.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("s")), 1, HEAD).alias("head"))
    signed = bits.join(comps, "key", "left").join(heads, "key").select("key", "n", "bits", F.coalesce("comp", "key").alias("comp"), "head")
    units = small.unionByName(large).join(signed, "key").select("unit", "s", "key", "n", "bits", "comp", "head")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_tree_pairs(threshold), "a bigint, b bigint")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with their own columns. Rows that repeat an id stay as they
    are; rows with a null id stay too."""
    found = link_components(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, threshold)
    drop = bounded(found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__dropped")).distinct(), FEW_IDS, "dropped")
    return docs.join(drop, docs[id_col] == drop["__dropped"], "left_anti")
