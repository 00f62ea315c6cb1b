"""Runs of low or high depth, and hot spots away from the targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up
from .intervals import BIN, runs, sample_sweep, sweep


def depth_runs(segments: DataFrame, keep: Column, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """(by, contig, start, end, length, mean_depth): maximal runs of segments for which `keep` holds. Segments carry a bin; with
    interval ids in `by`, runs end with their interval."""
    kept = segments.filter(keep).withColumns({"sum_depth": F.col("depth") * (F.col("end") - F.col("start")), "kept": F.lit(True)})
    found = runs(kept, ["kept"], by, width, {"sum_depth": "sum"})
    length = F.col("end") - F.col("start")
    return found.select(*by, "contig", "start", "end", length.alias("length"), half_up(F.col("sum_depth") / length).alias("mean_depth"))


def low_runs(segments: DataFrame, low: int = 20, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    return depth_runs(segments, F.col("depth") < low, by, width)


def high_runs(segments: DataFrame, high: int = 10_000, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    return depth_runs(segments, F.col("depth") >= high, by, width)


def off_target(rle: DataFrame, targets: DataFrame, level: int = 20, pad: int = 500, width: int = BIN, by: Sequence[str] = (), samples: DataFrame | None = None) -> DataFrame:
    """(by, set_id, contig, start, end, max_depth): runs of depth outside of all targets of this and the earlier sets, padded by
    `pad` bases (one more after the end), that exceed `level` somewhere; each is reported from its first base that does. With
    `by`, `samples` has the distinct keys, a row for each sample.

    A base is free for the sets before the lowest one that covers it. So the targets of all sets make one table of stretches with
    their lowest set, and one sweep cuts the depth at its edges, however many sets there are.
    """
    padded = targets.select("set_id", "contig", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), (F.col("end") + pad + 1).alias("end"))
    sets = sorted(r.set_id for r in targets.select("set_id").distinct().collect())  # the lines of a manifest
    if not sets:
        return rle.filter("false").select(*by, F.lit(None).cast(dict(targets.dtypes)["set_id"]).alias("set_id"), "contig", "start", "end", F.col("depth").alias("max_depth"))
    low_bit = lambda c: F.log2(F.col(c).bitwiseAND(-F.col(c)).cast("double")).cast("int")  # noqa: E731  (the 64th bit is negative)
    place = [F.when(F.col(c) == -(1 << 63), 63).when(F.col(c) != 0, low_bit(c)) + 64 * k + 1 for k, c in enumerate(f"set_{k}" for k in range(-(-len(sets) // 64)))]
    cover = sample_sweep(padded, "set_id", (), width, sets).select("contig", "start", "end", F.coalesce(*place).alias("weight"))
    if by:
        cover = cover.join(F.broadcast(samples.select(*by)))
    deep = rle.filter("depth > 0").select(*by, "contig", "start", "end", F.col("depth").alias("weight"))
    segments = sweep({"depth": deep, "cover": cover}, by, width).filter("depth > 0")
    free = F.slice(F.array(*map(F.lit, sets)), F.lit(1), F.when(F.col("cover") == 0, len(sets)).otherwise(F.col("cover") - 1).cast("int"))
    rows = segments.select(*by, "contig", "bin", "start", "end", "depth", F.explode(free).alias("set_id"))
    rows = rows.withColumns({"free": F.lit(True), "max_depth": F.col("depth"), "first": F.when(F.col("depth") > level, F.col("start"))})
    found = runs(rows, ["free"], [*by, "set_id"], width, {"max_depth": "max", "first": "min"})
    return found.filter(F.col("max_depth") > level).select(*by, "set_id", "contig", F.col("first").alias("start"), "end", "max_depth")
