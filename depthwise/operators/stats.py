"""Histograms, summaries and profiles of depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import THRESHOLDS, half_up, percent
from .intervals import JOIN_BIN, overlap_join, sweep

CAP = 1000
#: Depths from here on don't enter the median.
MEDIAN_LIMIT = 19_998


def depth_counts(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, depth, n): bases at each depth. Everything below reads this small table instead of the segments."""
    return segments.groupBy(*by, "depth").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n"))


def histogram(counts: DataFrame, by: Sequence[str] = (), cap: int = CAP) -> DataFrame:
    """Bases by depth, what is beyond the cap in its bin, with a row for every depth up to the cap."""
    spark = counts.sparkSession
    capped = counts.groupBy(*by, F.least("depth", F.lit(cap)).cast("bigint").alias("depth")).agg(F.sum("n").alias("n"))
    every = spark.range(cap + 1).withColumnRenamed("id", "depth")
    if by:
        every = counts.select(*by).distinct().join(F.broadcast(every))
    return every.join(capped, [*by, "depth"], "left").select(*by, "depth", F.coalesce("n", F.lit(0)).alias("n_bases"))


def breadth(counts: DataFrame, total: str, by: Sequence[str] = (), excluded: str | None = None) -> DataFrame:
    """(by, threshold, n_bases, pct): bases at 0, and at or above each threshold, with their share of column `total` of counts;
    column `excluded` is taken from the bases at 0."""
    cells = [F.sum(F.when(F.col("depth") == 0 if t == 0 else F.col("depth") >= t, F.col("n")).otherwise(0)).alias(f"t{t}") for t in THRESHOLDS]
    less = F.first(excluded) if excluded else F.lit(0)
    wide = counts.groupBy(*by).agg(*cells, F.first(total).alias("__total"), less.alias("__less"))
    value = lambda t: (F.col(f"t{t}") - F.col("__less") if t == 0 else F.col(f"t{t}")).cast("bigint")
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), value(t).alias("n_bases"), percent(value(t), F.col("__total")).alias("pct")) for t in THRESHOLDS))
    return wide.select(*by, F.inline(rows))


def summary(counts: DataFrame, total: str, by: Sequence[str] = (), excluded: str | None = None) -> DataFrame:
    """(by, bases, sum_depth, mean_depth, median_depth, max_depth, bases_at_max). The median is the lowest depth up to which half
    of the bases lie, rounded down; bases in column `excluded` don't count at depth 0."""
    less = F.col(excluded) if excluded else F.lit(0)
    rest = F.when(F.col("depth") == 0, F.col("n") - less).otherwise(F.col("n"))
    w = Window.partitionBy(*by).orderBy("depth") if by else Window.orderBy("depth")
    rows = counts.withColumn("__sum", F.sum(rest).over(w)).withColumn("__half", F.floor(F.col(total) / 2))
    got = rows.groupBy(*by).agg(
        F.first(total).alias("bases"),
        F.sum(F.col("depth") * F.col("n")).cast("bigint").alias("sum_depth"),
        F.min(F.when((F.col("__sum") >= F.col("__half")) & (F.col("depth") <= MEDIAN_LIMIT), F.col("depth"))).alias("median_depth"),
        F.max("depth").alias("max_depth"),
        F.max_by("n", "depth").alias("bases_at_max"),
    )
    return got.select(*by, "bases", "sum_depth", (F.col("sum_depth") / F.col("bases")).alias("mean_depth"), F.coalesce("median_depth", F.lit(0)).alias("median_depth"), "max_depth", "bases_at_max")


def targeted_bases(targets: DataFrame, contigs: DataFrame, by: Sequence[str] = ("set_id",)) -> DataFrame:
    """(by, n_targets, targeted_bases); a target beyond the end of its contig counts as far as that."""
    long = targets.join(F.broadcast(contigs.select("contig", "length")), "contig")
    return long.groupBy(*by).agg(F.count("*").alias("n_targets"), F.sum(F.least("end", "length") - F.col("start")).cast("bigint").alias("targeted_bases"))


def all_sites(on_target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each target with its length and rounded mean depth over that length."""
    keys = [*by, "set_id", "contig", "interval_id", "t_start", "t_end"]
    total = on_target.groupBy(*keys).agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("s"))
    return total.select(*keys, (F.col("t_end") - F.col("t_start")).alias("length"), half_up(F.col("s") / (F.col("t_end") - F.col("t_start"))).alias("mean_depth"))


def target_hits(on_target: DataFrame, rle: DataFrame, targets: DataFrame, size: int = 100, width: int = JOIN_BIN, by: Sequence[str] = (), samples: DataFrame | None = None) -> DataFrame:
    """(by, set_id, n_targets, n_hit, n_buffer_only): targets with depth, and those without whose `size` bases upstream have some.
    With `by`, `samples` has the distinct keys, a row for each sample.

    Both are found in one pass: depth on a target and depth upstream of it are two kinds of hits of the target.
    """
    keys = ["set_id", "contig", "interval_id"]
    deep = rle.filter("depth > 0").select(*(F.col(c).alias(f"k_{c}") for c in by), "contig", "start", "end")
    upstream = targets.select(*keys, F.greatest(F.col("start") - size, F.lit(0)).alias("start"), F.col("start").alias("end"))
    near = overlap_join(upstream, deep, width=width).select(*(F.col(f"b_k_{c}").alias(c) for c in by), *keys, F.lit(False).alias("hit"))
    found = on_target.filter("depth > 0").select(*by, *keys, F.lit(True).alias("hit")).unionByName(near).groupBy(*by, *keys).agg(F.max("hit").alias("hit"))
    counts = found.groupBy(*by, "set_id").agg(F.count_if("hit").alias("n_hit"), F.count_if(~F.col("hit")).alias("n_buffer_only"))
    every = targets.groupBy("set_id").agg(F.count("*").alias("n_targets"))
    if by:
        every = every.join(F.broadcast(samples.select(*by)))
    return every.join(counts, [*by, "set_id"], "left").select(*by, "set_id", "n_targets", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_buffer_only")))


def flank_profile(rle: DataFrame, targets: DataFrame, reach: int = 1000, shortest: int = 100, width: int = JOIN_BIN) -> DataFrame:
    """(set_id, side, distance, sum_depth): depth summed over the targets of at least `shortest` bases, by the distance (from 0)
    of a base before the start or after the end of its target."""
    long = targets.filter(F.col("end") - F.col("start") >= shortest)
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.alias("start"), b.alias("end"))
    flanks = long.select("set_id", "contig", F.col("start").alias("s"), F.col("end").alias("e"), F.inline(F.array(side("up", F.greatest(F.col("start") - reach, F.lit(0)), F.col("start")), side("down", F.col("end"), F.col("end") + reach))))
    pairs = overlap_join(flanks, rle.filter("depth > 0").select("contig", "start", "end", "depth"), width=width)
    # runs of depth become runs of distances; what they add is summed at their ends only
    up = F.col("side") == "up"
    near = F.when(up, F.col("s") - F.col("hi")).otherwise(F.col("lo") - F.col("e"))
    far = F.when(up, F.col("s") - F.col("lo")).otherwise(F.col("hi") - F.col("e"))
    spans = pairs.select("set_id", "side", F.lit("").alias("contig"), near.alias("start"), far.alias("end"), F.col("b_depth").alias("weight"))
    summed = sweep({"sum_depth": spans}, ["set_id", "side"], max(reach, 1))
    return summed.select("set_id", "side", F.explode(F.sequence("start", F.col("end") - 1)).alias("distance"), "sum_depth")


def target_profile(on_target: DataFrame, shortest: int = 100) -> DataFrame:
    """(set_id, pct_bin, value): the bases of each target of at least `shortest` bases go to 101 bins by their relative place, the
    rounded mean depth of each bin is summed over the targets."""
    long = on_target.filter(F.col("t_end") - F.col("t_start") >= shortest)
    # runs of depth are cut at the bins' edges: bin k starts at the first base x of the target with (200 x + n) / 2 n >= k
    n, bin_of = F.col("t_end") - F.col("t_start"), lambda x: F.floor((x * 200 + n) / (n * 2)).cast("int")
    first = lambda k: F.col("t_start") + F.ceil((k * 2 - 1) * n / 200)
    cut = long.withColumn("pct_bin", F.explode(F.sequence(bin_of(F.col("start") - F.col("t_start")), bin_of(F.col("end") - 1 - F.col("t_start")))))
    bases = F.least("end", first(F.col("pct_bin") + 1)) - F.greatest("start", first(F.col("pct_bin")))
    each = cut.withColumn("bases", bases).groupBy("set_id", "contig", "interval_id", F.col("pct_bin").cast("bigint").alias("pct_bin")).agg(half_up(F.sum(F.col("depth") * F.col("bases")) / F.sum("bases")).alias("v"))
    return each.groupBy("set_id", "pct_bin").agg(F.sum("v").cast("bigint").alias("value"))


def coverage_categories(rows: DataFrame, pct: str = "pct", by: Sequence[str] = ("level",)) -> DataFrame:
    """(by, category, n, share): how many rows are covered by 100, at least 97, at least 90 and less than 90 per cent."""
    category = F.when(F.col(pct) >= 100, "100").when(F.col(pct) >= 97, ">=97").when(F.col(pct) >= 90, ">=90").otherwise("<90")
    plain = rows.filter(~F.coalesce("contig", F.lit("")).rlike("(?i)_alt|_random")) if "contig" in rows.columns else rows
    n = plain.groupBy(*by, category.alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))
