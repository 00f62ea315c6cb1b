"""Compositions of the operators: whole-genome, capture and batch reports, over tables of the data model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import THRESHOLDS, percent
from ..operators import batch, depth, genes, intervals, reads, runs, stats, uniformity
from ..operators.reads import ReadOptions, metric_rows
from ..storage import stored


@dataclass
class Sample:
    """The tables of one sample; or, with `by` (columns of the alignments that name a sample), of a cohort, each of whose samples
    has its own rows in every report, all of them in one job. Contigs, N regions and targets are those of all samples."""

    alignments: DataFrame
    contigs: DataFrame
    n_regions: DataFrame
    options: ReadOptions = ReadOptions()
    width: int = intervals.BIN
    by: tuple[str, ...] = ()
    _kept: dict[str, DataFrame | None] = field(default_factory=dict, repr=False)

    def _once(self, name: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def samples(self) -> DataFrame | None:
        """The distinct keys, a row for each sample, written once; none without `by`."""
        return self._once("samples", lambda: stored(self.alignments.select(*self.by).distinct(), "samples")) if self.by else None

    def per_sample(self, df: DataFrame) -> DataFrame:
        """A small table that all samples share, for each of them."""
        return depth.per_sample(df, self.samples()) if self.by else df

    def forms(self) -> DataFrame | None:
        return self._once("forms", lambda: reads.cigar_forms(self.alignments))

    def used(self) -> DataFrame:
        return reads.staged(self.alignments, self.options).filter("stage = 'used'")

    def blocks(self) -> DataFrame:
        return reads.depth_blocks(self.used(), self.contigs, self.options, self.by, self.forms()).select(*self.by, "contig", "start", "end")

    def rle(self) -> DataFrame:
        return depth.depth_rle(self.blocks(), self.per_sample(self.contigs), self.by, self.width, self.per_sample(self.n_regions))

    def depth(self) -> DataFrame:
        """rle, computed and written once, for reports that read it several times."""
        return self._once("depth", lambda: stored(self.rle(), "depth"))

    def genome(self) -> DataFrame:
        """One row: genome_bases, n_total, n_x, n_y, bases (without N)."""
        size = self.contigs.agg(F.sum("length").cast("bigint").alias("genome_bases"))
        return size.join(F.broadcast(depth.n_bases(self.n_regions, self.contigs))).withColumn("bases", F.col("genome_bases") - F.col("n_total"))

    def joined(self, row: DataFrame, part: DataFrame) -> DataFrame:
        """Facts of one row for each sample put side by side; a part without the keys holds for all."""
        keys = [c for c in self.by if c in part.columns]
        return row.join(F.broadcast(part), keys) if keys else row.join(F.broadcast(part))


def wgs_counts(s: Sample, rle: DataFrame | None = None) -> DataFrame:
    """Depth counts of the genome with the columns bases and n_total on each row."""
    return stats.depth_counts(rle if rle is not None else s.rle(), s.by).join(F.broadcast(s.genome().select("bases", "n_total")))


def wgs_breadth(s: Sample) -> DataFrame:
    return stats.breadth(wgs_counts(s), "bases", s.by, excluded="n_total")


def uniformity_metric(s: Sample, lower: int = 1, upper: int = 150, factor: float = 10) -> DataFrame:
    rle = s.depth()
    blocks = uniformity.gvcf_blocks(rle, lower, upper, factor, s.by, s.width)
    mean = stats.summary(wgs_counts(s, rle), "bases", s.by, excluded="n_total").select(*s.by, "mean_depth")
    facts = s.joined(mean, s.genome().select("n_total", "n_x", "n_y"))
    return uniformity.metric(uniformity.smoothed_histogram(blocks, s.by), facts, s.by)


def breadth_metrics() -> list[tuple[str, Column]]:
    return [(f"Bases_with_{t}x_coverage", F.col(f"t{t}")) for t in THRESHOLDS] + [(f"PCT_of_Bases_with_{t}x_coverage", percent(F.col(f"t{t}"), F.col("bases"))) for t in THRESHOLDS]


def _wide_breadth(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("threshold") == t, F.col("n_bases"))).alias(f"t{t}") for t in THRESHOLDS))


def wgs_summary(s: Sample) -> DataFrame:
    """(by, metric, value) of the whole-genome report; every part is one row for each sample, joined by broadcast. The alignments
    are read for the depth, for the counters, and for the base qualities; with a minimum base quality once more."""
    by, counts = s.by, wgs_counts(s, s.depth())
    unique = F.col("aligned_bases")
    overlap = F.sum("overlap_bases") if s.options.exclude_overlap else F.lit(0)
    shared = reads.mate_overlap(s.used()) if s.options.exclude_overlap else s.samples() if by else s.contigs
    parts = [
        stats.summary(counts, "bases", by, excluded="n_total"),
        _wide_breadth(stats.breadth(counts, "bases", by, excluded="n_total"), by),
        reads.quality_counts(s.used(), s.contigs, s.options, by, s.forms()),
        s.genome().select("n_total", "genome_bases"),
        shared.groupBy(*by).agg(overlap.cast("bigint").alias("overlap_bases")),
    ]
    if s.options.min_base_qual > 0:
        parts.append(s.blocks().groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("unique_bases")))
        unique = F.col("unique_bases")
    row = stored(reads.counters(s.alignments, s.contigs, s.options, by), "counters")
    general = reads.read_report(row, by)
    for p in parts:
        row = s.joined(row, p)
    rows = [
        ("Average_Coverage", percent(F.col("sum_depth"), F.col("bases")) / 100),
        ("WGS_Max_Coverage", F.col("max_depth")), ("Number_of_Bases_with_WGS_Max_Coverage", F.col("bases_at_max")), ("Total_Genome_Base_Targeted_wo_Ns", F.col("bases")), ("Total_Ns_Bases_in_Ns_Regions", F.col("n_total")),
        ("Total_Mapped_Bases", F.col("mapped_bases")), ("Total_Uniquely_Aligned_Bases", unique), ("Total_Overlapped_Aligned_Bases", F.col("overlap_bases")),
        ("PCT_Overlapped_Aligned_Bases", percent(F.col("overlap_bases"), F.col("mapped_bases"))), ("Median_Coverage", F.col("median_depth")),
    ]
    for t in (20, 30, 40):
        rows += [(f"Aligned_Q{t}_Bases", F.col(f"q{t}_bases")), (f"PCT_Aligned_Q{t}_Bases", percent(F.col(f"q{t}_bases"), F.col("mapped_bases")))]
    return general.unionByName(metric_rows(row, rows + breadth_metrics(), by))


def on_target(s: Sample, targets: DataFrame) -> DataFrame:
    return depth.target_depth(s.rle(), targets, s.by)


def target_counts(s: Sample, targets: DataFrame) -> DataFrame:
    bases = stats.targeted_bases(targets, s.contigs).select("set_id", F.col("targeted_bases").alias("bases"))
    return stats.depth_counts(on_target(s, targets), [*s.by, "set_id"]).join(F.broadcast(bases), "set_id")


def capture_summary(s: Sample, targets: DataFrame, buffer: int = 100) -> DataFrame:
    """(by, set_id, metric, value) of the capture report. Depth, flanks and depth on the targets are written once, and the bases
    of each set are counted once."""
    by, keys, rle = s.by, [*s.by, "set_id"], s.depth()
    flanks = stored(intervals.buffers(targets, s.contigs, buffer, width=s.width), "flanks")
    inside = stored(depth.target_depth(rle, targets, by), "inside")
    sets = stored(stats.targeted_bases(targets, s.contigs).join(flanks.groupBy("set_id").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("buffer_bases")), "set_id", "left"), "sets")  # a row for each set
    counts = stored(stats.depth_counts(inside, keys).join(F.broadcast(sets.select("set_id", F.col("targeted_bases").alias("bases"))), "set_id"), "counts")
    row = s.per_sample(sets)
    for part in (
        stats.summary(counts, "bases", keys),
        _wide_breadth(stats.breadth(counts, "bases", keys), keys),
        reads.target_classes(s.used(), s.contigs, targets, flanks, s.options, by=by, forms=s.forms()),
        stats.target_hits(inside, rle, targets, buffer, by=by, samples=s.samples()).drop("n_targets"),
        runs.off_target(rle, targets, width=s.width, by=by, samples=s.samples()).groupBy(*keys).agg(F.count("*").alias("n_hot")),
    ):
        row = row.join(F.broadcast(part), keys, "left")  # a row for each set and sample
    row = s.joined(row, reads.counters(s.alignments, s.contigs, s.options, by).select(*by, "reads_aligned")).na.fill(0)
    aligned, hit = F.col("reads_aligned"), F.col("on_target") + F.col("in_buffer")
    rows = [
        ("Average_Coverage", percent(F.col("sum_depth"), F.col("bases")) / 100), ("Aligned_Reads_On_Buffer", F.col("in_buffer")), ("PCT_of_Aligned_Reads_On_Buffer", percent(F.col("in_buffer"), aligned)),
        ("Aligned_Reads_On_Target", F.col("on_target")), ("PCT_of_Aligned_Reads_On_Target", percent(F.col("on_target"), aligned)), ("Median_Coverage", F.col("median_depth")),
        ("Target_Max_Coverage", F.col("max_depth")), ("Number_of_Bases_with_Target_Max_Coverage", F.col("bases_at_max")), ("Reads_that_hit_target_or_buffer", hit), ("PCT_of_Reads_that_hit_target_or_buffer", percent(hit, aligned)),
        ("Off_Target_Reads", F.col("off_target")), ("Total_Targets", F.col("n_targets")), ("Targets_with_Coverage_Hit", F.col("n_hit")), ("PCT_of_Targets_with_Coverage_Hit", percent(F.col("n_hit"), F.col("n_targets"))),
        ("Targets_with_Buffer_Hit_only", F.col("n_buffer_only")), ("Non_target_regions_with_high_coverage", F.col("n_hot")), ("Bases_Targeted", F.col("targeted_bases")), ("Buffer_Bases", F.col("buffer_bases")),
    ]
    return metric_rows(row, rows + breadth_metrics(), keys)


def low_in_targets(s: Sample, targets: DataFrame, low: int = 20, set_id: int | None = None) -> DataFrame:
    """Low runs inside each target."""
    chosen = targets if set_id is None else targets.filter(F.col("set_id") == set_id)
    return runs.low_runs(depth.target_depth(s.rle(), chosen, s.by), low, [*s.by, "set_id", "interval_id"], s.width)


def cds_report(s: Sample, targets: DataFrame, cds: DataFrame, low: int = 20, set_id: int = 0) -> DataFrame:
    found = low_in_targets(s, targets, low, set_id).select(*s.by, "contig", "start", "end")
    return genes.cds_coverage(cds, found, s.by, samples=s.samples())


def batch_exons(regions: DataFrame, cds: DataFrame, pct: float = 50, width: int = intervals.BIN) -> DataFrame:
    return batch.exon_coverage(batch.recurrent(regions, pct, width=width), cds)
