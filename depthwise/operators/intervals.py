"""Interval operators on (contig, start, end) rows, half-open.

Nothing here needs a whole contig in one task: rows are dealt out by (keys, bin), an interval being clipped to each bin that it
touches, and what crosses an edge between bins is put together in a second step that sees only the pieces at the edges.
`by` names further key columns (a sample, a set); intervals of different keys never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a bin, for depth and for joins.
BIN, JOIN_BIN = 1 << 20, 1 << 14


def _div(x: Column | str, width: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / width).cast("int")


def binned(df: DataFrame, width: int, name: str = "bin") -> DataFrame:
    """A row for each bin that an interval touches, its number in the column `name`; empty intervals touch none."""
    return df.filter("start < end").withColumn(name, F.explode(F.sequence(_div("start", width), _div(F.col("end") - 1, width))))


def clipped_to_bins(df: DataFrame, width: int) -> DataFrame:
    low = F.col("bin") * width
    return binned(df, width).withColumns({"start": F.greatest("start", low), "end": F.least("end", low + width)})


def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int = JOIN_BIN, how: str = "inner", ids: Sequence[str] = ()) -> DataFrame:
    """Pairs of overlapping intervals: the columns of a, those of b (other than the keys) with the prefix b_, and the
    intersection as lo, hi.

    An equality join on the bins; a pair that shares several bins is kept in the one where its intersection starts. With how
    "left" rows of a without a partner stay, with nulls; they must then be told apart by the columns `ids`. A column `bin` of a or
    b is theirs, of another width, and stays as it is.
    """
    keys = [*by, "contig"]
    right = binned(b, width, "__bin").select(*keys, "__bin", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    pairs = binned(a, width, "__bin").join(right, [*keys, "__bin"])
    lo, hi = F.greatest("start", "b_start"), F.least("end", "b_end")
    pairs = pairs.filter((lo < hi) & (_div(lo, width) == F.col("__bin"))).withColumns({"lo": lo, "hi": hi}).drop("__bin").select(*a.columns, *(c for c in right.columns if c.startswith("b_")), "lo", "hi")
    if how == "inner":
        return pairs
    extra = pairs.columns[len(a.columns) :]
    kinds = dict(pairs.dtypes)
    alone = a.join(pairs.select(*ids).distinct(), list(ids), "left_anti").select(*a.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in extra))
    return pairs.unionByName(alone)


def sweep(inputs: dict[str, DataFrame], by: Sequence[str] = (), width: int = BIN, within: DataFrame | None = None, all_breaks: bool = False) -> DataFrame:
    """Segments (by, contig, bin, start, end) with, for each input, the number of its intervals that cover the segment.

    An input with a column `weight` counts its intervals that often. Equal neighbours inside a bin are one segment unless `all_breaks`. `within` (contig, length, with the keys if there are
    any) also gives the segments that nothing covers; without it those outside of all intervals are left out.
    """
    keys, names = [*by, "contig"], list(inputs)
    parts = []
    for name, df in inputs.items():
        cut = clipped_to_bins(df.select(*keys, "start", "end", F.col("weight") if "weight" in df.columns else F.lit(1).alias("weight")), width)
        event = lambda at, d: F.struct(F.col(at).cast("bigint").alias("pos"), *((F.col("weight") * d if n == name else F.lit(0)).cast("bigint").alias(n) for n in names))  # noqa: E731, B023
        parts.append(cut.select(*keys, "bin", F.explode(F.array(event("start", 1), event("end", -1))).alias("e")).select(*keys, "bin", "e.*"))
    if within is not None:
        nothing = [F.lit(0).cast("bigint").alias(n) for n in names]
        edges = clipped_to_bins(within.select(*keys, F.lit(0).alias("start"), F.col("length").alias("end")), width)
        parts += [edges.select(*keys, "bin", F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint"))).alias("pos"), *nothing)]
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    events = events.groupBy(*keys, "bin", "pos").agg(*(F.sum(n).alias(n) for n in names))
    w = Window.partitionBy(*keys, "bin").orderBy("pos")
    summed = events.withColumns({n: F.sum(n).over(w) for n in names} | {"end": F.lead("pos").over(w)}).filter("end is not null").withColumnRenamed("pos", "start")
    if within is None:
        summed = summed.filter(" or ".join(f"{n} > 0" for n in names))
    if not all_breaks:
        summed = islands(summed, names, keys=[*keys, "bin"])
    return summed.select(*keys, "bin", "start", "end", *names)


def islands(df: DataFrame, classes: Sequence[str], keys: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Neighbouring rows (end = next start) of equal classes put together, within the keys; `sums` are further aggregates."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.lag("end").over(w).isNull() | (F.lag("end").over(w) != F.col("start"))
    for c in classes:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    run = df.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w))
    more = [f.alias(n) for n, f in (sums or {}).items()]
    return run.groupBy(*keys, *classes, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("__run")


def runs(segments: DataFrame, classes: Sequence[str], by: Sequence[str] = (), width: int = BIN, sums: dict[str, str] | None = None) -> DataFrame:
    """Maximal runs of equal classes over segments with bins: first within the bins, then, for the runs that touch an edge of a
    bin only, across them. `sums` maps result columns to "sum", "min" or "max", of columns of that name.

    The second pass deals the runs out anew once: those at edges (at most two a bin) by contig, the others by their bin, where
    they are maximal already.
    """
    keys = [*by, "contig"]
    agg = {n: {"sum": F.sum, "min": F.min, "max": F.max}[f](n) for n, f in (sums or {}).items()}
    inner = islands(segments, classes, [*keys, "bin"], agg)
    edge = (F.col("start") == F.col("bin") * width) | (F.col("end") == (F.col("bin") + 1) * width)
    dealt = inner.withColumn("__place", F.when(edge, -1).otherwise(F.col("bin")))
    return islands(dealt, classes, [*keys, "__place"], agg).select(*keys, *classes, "start", "end", *agg)


def merge(df: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """The union of the intervals as maximal ones; touching intervals are one."""
    covered = sweep({"depth": df}, by, width).withColumn("covered", F.lit(True))
    return runs(covered, ["covered"], by, width).drop("covered")


def subtract(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """What a covers and b doesn't, as maximal intervals."""
    left = sweep({"a": a, "b": b}, by, width).filter("a > 0 and b = 0").withColumn("kept", F.lit(True))
    return runs(left, ["kept"], by, width).drop("kept")


def intersect(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int = JOIN_BIN) -> DataFrame:
    """The pieces of a inside b, a row for each overlapping pair, with the columns of a."""
    return overlap_join(a, b, by, width).withColumns({"start": F.col("lo"), "end": F.col("hi")}).select(*a.columns)


def partition(df: DataFrame, by: Sequence[str] = (), width: int = BIN, outside: DataFrame | None = None) -> DataFrame:
    """Disjoint segments between all neighbouring starts and ends, where at least one interval covers, with their number. What
    `outside` covers is left out, in the same sweep; cuts between neighbours stay."""
    keys = [*by, "contig"]
    points, inputs = df.filter("start < end").select(*keys, F.explode(F.array("start", "end")).alias("start")), {"depth": df}
    if outside is not None:  # a segment may begin where one of these ends
        points, inputs["outside"] = points.unionByName(outside.filter("start < end").select(*keys, F.col("end").alias("start"))), outside
    points = points.distinct().withColumn("real", F.lit(True))
    cut = sweep(inputs, by, width, all_breaks=True)
    if outside is not None:
        cut = cut.filter("depth > 0 and outside = 0")
    cut = cut.join(points, [*keys, "start"], "left").withColumn("real", F.coalesce("real", F.lit(False)))
    whole = (F.col("start") != F.col("bin") * width) & (F.col("end") != (F.col("bin") + 1) * width)
    w = Window.partitionBy(*keys).orderBy("start")
    edge = cut.filter(~whole).withColumn("__run", F.sum(F.col("real").cast("int")).over(w))  # at most two rows a bin
    stitched = edge.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth")).drop("__run")
    return cut.filter(whole).select(*keys, "start", "end", "depth").unionByName(stitched.select(*keys, "start", "end", "depth"))


def map_ids(segments: DataFrame, df: DataFrame, id_col: str, by: Sequence[str] = (), width: int = JOIN_BIN) -> DataFrame:
    """Each segment with the sorted ids of the intervals over it, joined by semicolons."""
    keys = [*by, "contig"]
    pairs = overlap_join(segments.select(*keys, "start", "end"), df.select(*keys, "start", "end", id_col), by, width)
    return pairs.groupBy(*keys, "start", "end").agg(F.array_join(F.array_sort(F.collect_set(f"b_{id_col}")), ";").alias("ids"))


def group_identical(df: DataFrame, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct interval, with the sorted ids of its copies joined by semicolons."""
    return df.groupBy(*by, "contig", "start", "end").agg(F.array_join(F.array_sort(F.collect_set(id_col)), ";").alias("ids"))


def sample_sweep(df: DataFrame, sample: str = "sample_id", by: Sequence[str] = (), width: int = BIN, names: Sequence | None = None) -> DataFrame:
    """Segments (by, contig, bin, start, end, n_samples) with the number of samples that cover, wherever one does; intervals of a
    sample may overlap. With `names`, all samples' names in an order, also columns set_0, set_1, ... of 64 samples each.

    One shuffle, by bin: within it the sum of a sample's starts and ends says where the sample begins and stops to cover. Each
    such place turns the sample's bit over, so that the running XOR over a bin is the set of samples that cover.
    """
    keys = [*by, "contig"]
    cut = clipped_to_bins(df.select(*keys, sample, "start", "end"), width)
    event = lambda at, d: F.struct(F.col(at).cast("bigint").alias("pos"), F.lit(d).alias("d"))
    events = cut.select(*keys, "bin", sample, F.explode(F.array(event("start", 1), event("end", -1))).alias("e")).select(*keys, "bin", sample, "e.*")
    events = events.repartition(*keys, "bin").groupBy(*keys, "bin", sample, "pos").agg(F.sum("d").alias("d"))
    own = Window.partitionBy(*keys, "bin", sample).orderBy("pos")
    after = F.sum("d").over(own)
    turn = F.when((after > 0) & (after - F.col("d") <= 0), 1).when((after <= 0) & (after - F.col("d") > 0), -1)
    turns = events.withColumn("turn", turn).filter("turn is not null")
    words = -(-len(names) // 64) if names is not None else 0
    if words:
        at = turns.sparkSession.createDataFrame([(x, k // 64, 1 << (k % 64) if k % 64 < 63 else -(1 << 63)) for k, x in enumerate(names)], f"{sample} {dict(df.dtypes)[sample]}, word int, bit bigint")
        turns = turns.join(F.broadcast(at), sample)  # a row for each sample
    sets = [f"set_{k}" for k in range(words)]
    moved = turns.groupBy(*keys, "bin", "pos").agg(F.sum("turn").alias("n_samples"), *(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(c) for k, c in enumerate(sets)))
    w = Window.partitionBy(*keys, "bin").orderBy("pos")
    running = {"n_samples": F.sum("n_samples").over(w), "end": F.lead("pos").over(w)} | {c: F.bit_xor(c).over(w) for c in sets}
    return moved.withColumns(running).filter("n_samples > 0").select(*keys, "bin", F.col("pos").alias("start"), "end", "n_samples", *sets)


def multi_depth(df: DataFrame, sample: str = "sample_id", by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """Maximal runs of equal number of samples that cover, wherever one does."""
    return runs(sample_sweep(df, sample, by, width), ["n_samples"], by, width).select(*by, "contig", "start", "end", "n_samples")


def multi_sets(df: DataFrame, sample: str = "sample_id", by: Sequence[str] = (), width: int = BIN, names: Sequence | None = None) -> DataFrame:
    """(by, contig, start, end, n_samples, samples): maximal runs that the same samples cover, with their sorted list.

    `names` are all samples there are, without nulls; else a job lists them, a name for each file of a study. Rows without a
    sample are left out.
    """
    if names is None:
        names = sorted(r[0] for r in df.select(sample).distinct().collect() if r[0] is not None)
    kind = dict(df.dtypes)[sample]
    found = runs(sample_sweep(df, sample, by, width, names), ["n_samples", *(f"set_{k}" for k in range(-(-len(names) // 64)))], by, width)

    def listed_of(k: int) -> Column:
        bits = F.col(f"set_{k // 64}")
        of = F.array(*(F.struct(F.lit(1 << j if j < 63 else -(1 << 63)).cast("bigint").alias("bit"), F.lit(x).cast(kind).alias("name")) for j, x in enumerate(names[k : k + 64])))
        return F.transform(F.filter(of, lambda s: bits.bitwiseAND(s["bit"]) != 0), lambda s: s["name"])

    listed = F.concat(*map(listed_of, range(0, len(names), 64))) if names else F.expr(f"cast(array() as array<{kind}>)")
    return found.select(*by, "contig", "start", "end", "n_samples", listed.alias("samples"))


def buffers(targets: DataFrame, contigs: DataFrame, size: int = 100, by: Sequence[str] = ("set_id",), width: int = BIN) -> DataFrame:
    """The flanks of the targets: `size` bases before each, and [end + 1, end + size + 1) after it (the base at `end` is neither
    target nor buffer); clipped to the contig, merged, without any target."""
    long = targets.join(F.broadcast(contigs.select("contig", "length")), "contig")
    sides = F.array(
        F.struct(F.greatest(F.col("start") - size, F.lit(0)).alias("start"), F.col("start").alias("end")),
        F.struct((F.col("end") + 1).alias("start"), F.least(F.col("end") + size + 1, F.col("length")).alias("end")),
    )
    flanks = long.select(*by, "contig", F.explode(sides).alias("s")).select(*by, "contig", "s.*").filter("start < end")
    return subtract(flanks, targets, by, width)
