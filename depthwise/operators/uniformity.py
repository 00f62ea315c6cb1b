"""Uniformity of depth: blocks of similar depth, their histogram, the share of its peak, and plot series."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SEX_CONTIGS, half_up, peak_size
from .intervals import BIN, overlap_join, runs, sweep
from .stats import CAP

BELOW, WITHIN, ABOVE = 0, 1, 2


def classed_blocks(rle: DataFrame, lower: int = 1, upper: int = 150, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """(by, contig, class, start, end, length, mean_depth): maximal runs below, within and above the bounds."""
    kind = F.when(F.col("depth") < lower, BELOW).when(F.col("depth") <= upper, WITHIN).otherwise(ABOVE)
    rows = rle.withColumns({"class": kind, "sum_depth": F.col("depth") * (F.col("end") - F.col("start"))})
    return _blocks(runs(rows, ["class"], by, width, {"sum_depth": "sum"}), by)


def _blocks(found: DataFrame, by: Sequence[str]) -> DataFrame:
    length = F.col("end") - F.col("start")
    return found.select(*by, "contig", "class", "start", "end", length.alias("length"), half_up(F.col("sum_depth") / length).alias("mean_depth"))


# ---- greedy split ------------------------------------------------------------------------------------------------------------
#
# Above the upper bound a block goes on, from the left, while its highest depth is at most `factor` times its lowest. The split of
# a run depends on where it starts, but of all that is to the left of a bin only the lowest and highest depth of the block that
# enters it matter. With these the block first breaks at a segment that is lower or higher than all before it in the bin, and what
# follows a break is the same whatever came before. So a bin is summed up by a table: for each such segment the state in which the
# bin is left if the block breaks there. Only these tables, a row for each bin, are read in order.


def _breaks(depth: list[int], factor: float) -> list[int]:
    """For each segment the one at which a block that starts there breaks; two ends move to the right only."""
    lows, highs, ends, j = deque(), deque(), [], 0
    for i in range(len(depth)):
        while j < len(depth):
            low, high = min(depth[j], depth[lows[0]] if lows else depth[j]), max(depth[j], depth[highs[0]] if highs else depth[j])
            if j > i and high > low * factor:
                break
            while lows and depth[lows[-1]] >= depth[j]:
                lows.pop()
            while highs and depth[highs[-1]] <= depth[j]:
                highs.pop()
            lows.append(j)
            highs.append(j)
            j += 1
        ends.append(j)
        for q in (lows, highs):
            if q and q[0] == i:
                q.popleft()
    return ends


def bin_transfer(depth: list[int], factor: float) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Of neighbouring segments: the places at which an entering block can break, each as (lowest and highest depth so far, lowest
    and highest depth of the block that is open at the end if it breaks there), and lowest and highest depth of all. The last
    place is where a block that starts here breaks; a block can't enter and go on beyond."""
    n, ends = len(depth), _breaks(depth, factor)
    left = [(0, 0)] * n
    low = high = depth[-1]
    suffix = [(0, 0)] * n
    for i in range(n - 1, -1, -1):
        low, high = min(low, depth[i]), max(high, depth[i])
        suffix[i] = low, high
        left[i] = suffix[i] if ends[i] == n else left[ends[i]]
    places, low, high = [], None, None
    for i in range(min(ends[0] + 1, n)):
        if low is None or depth[i] < low or depth[i] > high:
            low, high = (depth[i], depth[i]) if low is None else (min(low, depth[i]), max(high, depth[i]))
            places.append((low, high, *left[i]))
    return places, *suffix[0]


def through_bin(state: tuple[int, int], places, low: int, high: int, factor: float) -> tuple[int, int]:
    """Lowest and highest depth of the open block behind a bin that one of `state` has entered."""
    for a, b, x, y in places:
        if max(state[1], b) > min(state[0], a) * factor:
            return x, y
    return min(state[0], low), max(state[1], high)


def _runs_of(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """First and end row of each run of touching segments."""
    start, end = rows["start"].tolist(), rows["end"].tolist()
    cuts = [0, *(k for k in range(1, len(start)) if start[k] != end[k - 1]), len(start)]
    return list(zip(cuts[:-1], cuts[1:]))


def _transfers(keys: list[str], factor: float, width: int):
    """A bin's segments -> one row: whether a block can enter, whether it can pass through, the table for that, and the state in
    which the bin is left if none enters or passes (no low: no block is open at the end)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        depth, low = rows["depth"].tolist(), int(rows["bin"].iloc[0]) * width
        (a, b), (c, d) = (found := _runs_of(rows))[0], found[-1]
        enters, leaves = int(rows["start"].iloc[0]) == low, int(rows["end"].iloc[-1]) == low + width
        out = {k: rows[k].iloc[0] for k in keys} | {"bin": rows["bin"].iloc[0], "enters": enters, "passes": enters and leaves and len(found) == 1, "low": None, "high": None, "places": [], "all_low": None, "all_high": None}
        if leaves:
            ends, at = _breaks(depth[c:d], factor), 0
            while ends[at] < d - c:
                at = ends[at]
            out |= {"low": min(depth[c + at : d]), "high": max(depth[c + at : d])}
        if out["passes"]:
            places, all_low, all_high = bin_transfer(depth, factor)
            out |= {"places": [dict(zip("abxy", p)) for p in places], "all_low": all_low, "all_high": all_high}
        return pd.DataFrame([out])

    return run


def _entering(keys: list[str], factor: float):
    """Rows of one contig's bins in order -> the state of the block that enters each bin that one does."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, state, before = [], None, None
        for r in rows.sort_values("bin").to_dict("records"):
            state = state if before == r["bin"] - 1 and r["enters"] else None
            if state:
                out.append({k: r[k] for k in keys} | {"bin": r["bin"], "in_low": state[0], "in_high": state[1]})
            if state and r["passes"]:
                state = through_bin(state, [(p["a"], p["b"], p["x"], p["y"]) for p in r["places"]], int(r["all_low"]), int(r["all_high"]), factor)
            else:
                state = None if pd.isna(r["low"]) else (int(r["low"]), int(r["high"]))
            before = r["bin"]
        return pd.DataFrame(out, columns=[*keys, "bin", "in_low", "in_high"])

    return run


def _blocks_of_bin(keys: list[str], factor: float):
    """A bin's segments with the state that enters -> its blocks; `joined`: the block goes on from the bin before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        depth, start, end = rows["depth"].tolist(), rows["start"].tolist(), rows["end"].tolist()
        first = rows.iloc[0]
        state = None if pd.isna(first["in_low"]) else (int(first["in_low"]), int(first["in_high"]))
        out, joined = [], state is not None
        for a, b in _runs_of(rows):
            for k in range(a, b):
                low, high = (min(state[0], depth[k]), max(state[1], depth[k])) if state else (depth[k], depth[k])
                if state is None or high > low * factor:
                    joined, state = False, (depth[k], depth[k])
                    out.append([start[k], end[k], 0, False])
                else:
                    state = low, high
                    if joined and not out:
                        out.append([start[k], end[k], 0, True])
                out[-1][1] = end[k]
                out[-1][2] += depth[k] * (end[k] - start[k])
            state = None
        found = pd.DataFrame(out, columns=["start", "end", "sum_depth", "joined"])
        return found.assign(**{k: first[k] for k in [*keys, "bin"]})[[*keys, "bin", "start", "end", "sum_depth", "joined"]]

    return run


def gvcf_blocks(rle: DataFrame, lower: int = 1, upper: int = 150, factor: float = 10, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """As classed_blocks, with the runs above the upper bound split greedily from the left; rle carries bins.

    A task of the split sees one bin. Its summary goes to one row, the rows of a contig's bins are read in order for the state
    that enters each, and each bin is then split on its own; what goes on over an edge is put together from at most two rows a bin.
    """
    keys = [*by, "contig"]
    kind = F.when(F.col("depth") < lower, BELOW).when(F.col("depth") <= upper, WITHIN).otherwise(ABOVE)
    rows = rle.withColumns({"class": kind, "sum_depth": F.col("depth") * (F.col("end") - F.col("start"))})
    whole = _blocks(runs(rows.filter(F.col("class") != ABOVE), ["class"], by, width, {"sum_depth": "sum"}), by)
    pieces = rle.filter(F.col("depth") > upper).select(*keys, "bin", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("depth").cast("bigint").alias("depth"))
    kinds = ", ".join(f"{k} {dict(pieces.dtypes)[k]}" for k in [*keys, "bin"])
    states = pieces.groupBy(*keys, "bin").applyInPandas(_transfers(keys, factor, width), f"{kinds}, enters boolean, passes boolean, low bigint, high bigint, places array<struct<a:bigint,b:bigint,x:bigint,y:bigint>>, all_low bigint, all_high bigint")
    entering = states.groupBy(*keys).applyInPandas(_entering(keys, factor), f"{kinds}, in_low bigint, in_high bigint")
    known = pieces.join(entering, [*keys, "bin"], "left")
    found = known.groupBy(*keys, "bin").applyInPandas(_blocks_of_bin(keys, factor), f"{kinds}, start bigint, end bigint, sum_depth bigint, joined boolean")
    edge = (F.col("start") == F.col("bin") * width) | (F.col("end") == (F.col("bin") + 1) * width)
    w = Window.partitionBy(*keys, "__place").orderBy("start")
    dealt = found.withColumn("__place", F.when(edge, -1).otherwise(F.col("bin"))).withColumn("__block", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w))
    split = dealt.groupBy(*keys, "__place", "__block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("sum_depth").alias("sum_depth"))
    return whole.unionByName(_blocks(split.withColumn("class", F.lit(ABOVE)), by))


def smoothed_histogram(blocks: DataFrame, by: Sequence[str] = (), cap: int = CAP) -> DataFrame:
    """(by, depth, n_bases): block lengths by the block's mean depth, without the sex contigs, for every depth up to the cap."""
    rows = blocks.filter(~F.col("contig").isin(*SEX_CONTIGS))
    got = rows.groupBy(*by, F.least("mean_depth", F.lit(cap)).cast("bigint").alias("depth")).agg(F.sum("length").cast("bigint").alias("n"))
    every = blocks.sparkSession.range(cap + 1).withColumnRenamed("id", "depth")
    if by:
        every = blocks.select(*by).distinct().join(F.broadcast(every))
    return every.join(got, [*by, "depth"], "left").select(*by, "depth", F.coalesce("n", F.lit(0)).alias("n_bases"))


def metric(histogram: DataFrame, facts: DataFrame, by: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """(by, mode, peak_area, total_area, uniformity) from a histogram with all depths 0 to the cap and `facts` (by, mean_depth,
    n_total, n_x, n_y), one row for each key.

    N bases leave depth 0 and the total, those on the sex contigs come back to the total. The mode is the lowest depth from 1 on
    with the most bases. The peak grows from it by the larger neighbour until it has as many bins as the mean depth asks for;
    equal neighbours both come if two bins are left, else the right one; depth 0 and depths beyond the cap count nothing.
    """
    k = F.lit(size) if size else peak_size(F.col("mean_depth"))
    arrays = histogram.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n_bases"))), lambda s: s["n_bases"]).alias("h"), F.sum("n_bases").alias("all"))
    rows = (arrays.join(facts, list(by)) if by else arrays.join(F.broadcast(facts))).withColumn("k", k)
    n = F.size("h")
    best = F.array_max(F.slice("h", 2, n - 1))
    rows = rows.withColumn("mode", F.when(best > 0, F.array_position(F.slice("h", 2, n - 1), best)).otherwise(0).cast("int"))
    at = lambda i: F.when((i > 0) & (i < F.size("h")), F.coalesce(F.get("h", i), F.lit(0))).otherwise(F.lit(0))

    def step(acc, _):
        left, right = at(acc["left"]), at(acc["right"])
        done = acc["done"] | (acc["count"] >= F.col("k")) | ((left == 0) & (right == 0))
        both = (left == right) & (F.col("k") - acc["count"] >= 2)
        go_left, go_right = (left > right) | both, (right >= left)
        area = acc["area"] + F.when(go_left, left).otherwise(0) + F.when(go_right, right).otherwise(0)
        moved = F.struct(
            area.alias("area"),
            (acc["left"] - F.when(go_left, 1).otherwise(0)).alias("left"),
            (acc["right"] + F.when(go_right, 1).otherwise(0)).alias("right"),
            (acc["count"] + F.when(both, 2).otherwise(1)).alias("count"),
            F.lit(False).alias("done"),
        )
        same = F.struct(acc["area"].alias("area"), acc["left"].alias("left"), acc["right"].alias("right"), acc["count"].alias("count"), F.lit(True).alias("done"))
        return F.when(done, same).otherwise(moved)

    zero = F.get("h", F.lit(0)) - F.when(F.get("h", F.lit(0)) > F.col("n_total"), F.col("n_total")).otherwise(0)
    first = F.when(F.col("mode") == 0, zero).otherwise(F.get("h", F.col("mode")))
    start = F.struct(first.cast("bigint").alias("area"), (F.col("mode") - 1).alias("left"), (F.col("mode") + 1).alias("right"), F.lit(1).alias("count"), F.lit(False).alias("done"))
    rows = rows.withColumn("peak_area", F.aggregate(F.sequence(F.lit(1), F.lit(size or 13)), start, step, lambda acc: acc["area"]))
    rows = rows.withColumn("total_area", F.col("all") - F.col("n_total") + F.col("n_x") + F.col("n_y"))
    return rows.select(*by, "mode", "peak_area", "total_area", (F.col("peak_area") / F.col("total_area")).alias("uniformity"))


def mask_blocks(blocks: DataFrame, masks: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """(by, contig, start, end, length, mean_depth): blocks (disjoint) cut at the masks, with depth 0 inside."""
    keys = [*by, "contig"]
    cut = runs(sweep({"covered": blocks, "masked": masks}, by, width).filter("covered > 0").withColumn("masked", F.col("masked") > 0), ["masked"], by, width)
    pairs = overlap_join(blocks.select(*keys, "start", "end", "mean_depth"), cut, by, width)
    length = F.col("hi") - F.col("lo")
    return pairs.select(*keys, F.col("lo").alias("start"), F.col("hi").alias("end"), length.alias("length"), F.when(F.col("b_masked"), 0).otherwise(F.col("mean_depth")).cast("bigint").alias("mean_depth"))


def plot_points(blocks: DataFrame, by: Sequence[str] = (), highest: int = 200, shown: int = 198, step: int = 2000, width: int = BIN) -> DataFrame:
    """(by, contig, pos, value): a point at each block, clamped, and points of 0 every `step` bases of a gap between blocks. The
    block before one is found in its bin, or else from one row for each bin."""
    keys = [*by, "contig", "bin"]
    binned = blocks.withColumn("bin", F.floor(F.col("start") / width).cast("int"))
    last = binned.groupBy(*keys).agg(F.max_by("end", "start").alias("last"))
    last = last.withColumn("before", F.lag("last").over(Window.partitionBy(*by, "contig").orderBy("bin"))).drop("last")
    inside = F.lag("end").over(Window.partitionBy(*keys).orderBy("start"))
    rows = binned.withColumn("inside", inside).join(last, keys).withColumn("prev", F.coalesce("inside", "before"))
    point = F.when(F.col("mean_depth") > highest, shown).otherwise(F.col("mean_depth")).cast("bigint")
    gaps = rows.filter(F.col("prev") < F.col("start")).select(*by, "contig", F.explode(F.sequence(F.col("prev"), F.col("start") - 1, F.lit(step).cast("bigint"))).alias("pos"), F.lit(0).cast("bigint").alias("value"))
    return rows.select(*by, "contig", F.col("start").cast("bigint").alias("pos"), point.alias("value")).unionByName(gaps.withColumn("pos", F.col("pos").cast("bigint")))


def compare_samples(blocks: DataFrame, contig: str, sample: str = "sample_id") -> DataFrame:
    """Plot series of all samples on one contig."""
    return plot_points(blocks.filter(F.col("contig") == contig), [sample])
