"""Read depth as run-length segments, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, JOIN_BIN, overlap_join, runs, sweep


def depth_rle(blocks: DataFrame, contigs: DataFrame, by: Sequence[str] = (), width: int = BIN, n_regions: DataFrame | None = None) -> DataFrame:
    """(by, contig, bin, start, end, depth, in_n) over whole contigs; depth is 0 inside N regions. With `by`, `contigs` must hold
    the keys too (use `per_sample`)."""
    inputs = {"depth": blocks}
    if n_regions is not None:
        inputs["in_n"] = n_regions
    segments = sweep(inputs, by, width, within=contigs)
    if n_regions is None:
        return segments.withColumn("in_n", F.lit(False))
    return segments.withColumns({"depth": F.when(F.col("in_n") > 0, 0).otherwise(F.col("depth")), "in_n": F.col("in_n") > 0})


def per_sample(df: DataFrame, samples: DataFrame) -> DataFrame:
    """A copy of a small table (contigs, N regions) for each row of `samples`."""
    return samples.join(F.broadcast(df))


def maximal(rle: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """Depth runs without cuts at bins."""
    return runs(rle, ["depth"], by, width)


def base_depth(rle: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each base."""
    return rle.select(*by, "contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "depth")


def n_bases(n_regions: DataFrame, contigs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(n_total, n_x, n_y): bases of the N regions inside the contigs, and on the sex contigs."""
    long = n_regions.join(F.broadcast(contigs.select("contig", "length")), "contig").withColumn("n", F.greatest(F.least("end", "length") - F.col("start"), F.lit(0)).cast("bigint"))
    on = lambda *names: F.coalesce(F.sum(F.when(F.col("contig").isin(*names), F.col("n"))), F.lit(0))
    return long.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), on("chrX", "X").alias("n_x"), on("chrY", "Y").alias("n_y"))


def target_depth(rle: DataFrame, targets: DataFrame, by: Sequence[str] = (), width: int = JOIN_BIN) -> DataFrame:
    """(by, set_id, contig, interval_id, t_start, t_end, bin, start, end, depth): depth segments clipped to each target. Targets are
    those of every sample."""
    segments = rle.select(*(F.col(c).alias(f"k_{c}") for c in by), "contig", "bin", "start", "end", "depth")
    pairs = overlap_join(targets.select("set_id", "contig", "interval_id", "start", "end"), segments, (), width)
    return pairs.select(*(F.col(f"b_k_{c}").alias(c) for c in by), "set_id", "contig", "interval_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("b_bin").alias("bin"), F.col("lo").alias("start"), F.col("hi").alias("end"), F.col("b_depth").alias("depth"))
