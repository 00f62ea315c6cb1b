"""The registered queries: each operator over tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, annotation_etl, batch, depth, genes, intervals, reads, runs, stats, uniformity
from ..operators.reads import ReadOptions
from ..sources import fixtures, sinks, validate
from . import reports, roundtrips

#: Bases of a bin in these queries: the derived contigs have 8,000 to 24,000 bases.
WIDTH = 4096
QUERIES = dict(roundtrips.QUERIES)


def query(f):
    QUERIES[f.__name__] = f
    return f


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(*self._at, name)

    def sample(self, **options) -> reports.Sample:
        return reports.Sample(self.alignments, self.contigs, self.n_regions, ReadOptions(**options), WIDTH)


def _spans(df: DataFrame) -> DataFrame:
    """Interval columns as BIGINT start_pos, end_pos."""
    named = df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return named.withColumns({c: F.col(c).cast("bigint") for c in ("start_pos", "end_pos") if c in named.columns})


@query
def wgs_breadth(spark, sf_dir):
    return reports.wgs_breadth(Tables(spark, sf_dir).sample()).select(F.col("threshold").cast("bigint").alias("threshold"), "n_bases", "pct")


@query
def wgs_depth_rle(spark, sf_dir):
    return _spans(depth.maximal(Tables(spark, sf_dir).sample().rle(), (), WIDTH).select("contig", "start", "end", "depth"))


@query
def wgs_histogram(spark, sf_dir):
    return stats.histogram(stats.depth_counts(Tables(spark, sf_dir).sample().rle()))


@query
def wgs_summary(spark, sf_dir):
    return reports.wgs_summary(Tables(spark, sf_dir).sample())


@query
def depth_summary(spark, sf_dir):
    return stats.summary(reports.wgs_counts(Tables(spark, sf_dir).sample()), "bases", excluded="n_total")


@query
def n_region_bases(spark, sf_dir):
    """Bases of the N regions (set -1) and of the targets of each set inside the contigs, and on the sex contigs."""
    t = Tables(spark, sf_dir)
    regions = t.targets.select("set_id", "contig", "start", "end").unionByName(t.n_regions.select(F.lit(-1).alias("set_id"), "contig", "start", "end"))
    return depth.n_bases(regions, t.contigs, ["set_id"])


@query
def read_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reads.read_report(reads.counters(t.alignments, t.contigs))


@query
def read_stats_by_contig(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reads.counters(t.alignments, t.contigs, ReadOptions(min_map_qual=10), ["contig"]).drop("read_length")


@query
def read_length(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reads.counters(t.alignments, t.contigs).select("read_length")


@query
def downsample_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reads.downsample(t.alignments, 0.25, 11).groupBy("contig").agg(F.count("*").alias("reads"))


@query
def cigar_blocks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = reads.blocks(t.sample().used(), t.contigs)
    return found.groupBy("contig", "kind").agg(F.count("*").alias("n_blocks"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("bases"), F.sum(F.col("start").cast("bigint") * 7 + F.col("q_start")).cast("bigint").alias("checksum"))


@query
def base_quality(spark, sf_dir):
    s = Tables(spark, sf_dir).sample(min_base_qual=20)
    counts = reads.quality_counts(s.used(), s.contigs, s.options)
    kept = s.blocks().groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("bases"))
    return kept.join(F.broadcast(counts)).select("contig", "bases", "q20_bases", "q30_bases", "q40_bases")


@query
def mate_overlap(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t.sample(exclude_overlap=True)
    marked = reads.mate_overlap(s.used())
    some = marked.groupBy("contig").agg(F.sum("overlap_bases").cast("bigint").alias("overlap_bases"), F.count_if("inside_mate").alias("n_inside"), F.count_if(F.col("overlap_bases") > 0).alias("n_overlapping"))
    unique = s.blocks().groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("unique_bases"))
    return some.join(unique, "contig", "left")


@query
def read_target_class(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reads.target_classes(t.sample().used(), t.contigs, t.targets, intervals.buffers(t.targets, t.contigs)).withColumn("set_id", F.col("set_id").cast("bigint"))


@query
def target_buffer_bases(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flanks = intervals.buffers(t.targets, t.contigs, width=WIDTH).groupBy("set_id").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("buffer_bases"))
    return stats.targeted_bases(t.targets, t.contigs).join(flanks, "set_id")


@query
def capture_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.capture_summary(t.sample(), t.targets)


@query
def capture_histogram(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.histogram(stats.depth_counts(reports.on_target(t.sample(), t.targets), ["set_id"]), ["set_id"])


@query
def target_hits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rle = t.sample(min_map_qual=58).rle()
    return stats.target_hits(depth.target_depth(rle, t.targets), rle, t.targets)


@query
def target_profile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.target_profile(reports.on_target(t.sample(), t.targets))


@query
def flank_profile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.flank_profile(t.sample().rle(), t.targets, 300)


@query
def low_runs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(reports.low_in_targets(t.sample(), t.targets).drop("interval_id")).withColumn("length", F.col("length").cast("bigint"))


@query
def wgs_low_runs(spark, sf_dir):
    return _spans(runs.low_runs(Tables(spark, sf_dir).sample().rle(), 20, (), WIDTH)).withColumn("length", F.col("length").cast("bigint"))


@query
def high_runs(spark, sf_dir):
    return _spans(runs.high_runs(Tables(spark, sf_dir).sample().rle(), 60, (), WIDTH)).withColumn("length", F.col("length").cast("bigint"))


@query
def all_sites(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.all_sites(reports.on_target(t.sample(), t.targets)).select("set_id", "contig", F.col("t_start").cast("bigint").alias("start_pos"), F.col("t_end").cast("bigint").alias("end_pos"), F.col("length").cast("bigint").alias("length"), "mean_depth")


@query
def off_target(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(runs.off_target(t.sample().rle(), t.targets, pad=30, width=WIDTH))


@query
def uniformity_blocks(spark, sf_dir):
    found = uniformity.classed_blocks(Tables(spark, sf_dir).sample().rle(), 1, 30, (), WIDTH)
    return _spans(found).select("contig", "start_pos", "end_pos", F.col("length").cast("bigint").alias("length"), F.col("class").cast("bigint").alias("class"), "mean_depth")


@query
def uniformity_gvcf(spark, sf_dir):
    found = uniformity.gvcf_blocks(Tables(spark, sf_dir).sample().rle(), 1, 10, 2, (), WIDTH)
    return _spans(found).select("contig", "start_pos", "end_pos", F.col("length").cast("bigint").alias("length"), F.col("class").cast("bigint").alias("class"), "mean_depth")


@query
def uniformity_hist(spark, sf_dir):
    return uniformity.smoothed_histogram(uniformity.classed_blocks(Tables(spark, sf_dir).sample().rle(), 1, 150, (), WIDTH))


@query
def uniformity_metric(spark, sf_dir):
    return reports.uniformity_metric(Tables(spark, sf_dir).sample()).withColumns({c: F.col(c).cast("bigint") for c in ("mode", "peak_area", "total_area")})


@query
def plot_points(spark, sf_dir):
    found = uniformity.classed_blocks(Tables(spark, sf_dir).sample().rle(), 1, 30, (), WIDTH).filter("class <> 0")
    return uniformity.plot_points(found, highest=40, shown=38, step=100, width=WIDTH)


@query
def mask_blocks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = uniformity.classed_blocks(t.sample().rle(), 1, 30, (), WIDTH)
    masks = t.contigs.select("contig", F.floor(F.col("length") / 3).cast("int").alias("start"), (F.floor(F.col("length") / 3) + 700).cast("int").alias("end"))
    return _spans(uniformity.mask_blocks(found, masks, (), WIDTH)).withColumn("length", F.col("length").cast("bigint"))


@query
def interval_merge(spark, sf_dir):
    return _spans(intervals.merge(Tables(spark, sf_dir).sample_regions, ["sample_id"], WIDTH))


@query
def interval_subtract(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(intervals.subtract(t.sample_regions, t.targets.filter("set_id = 0"), (), WIDTH))


@query
def interval_intersect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(intervals.intersect(t.sample_regions, t.targets.filter("set_id = 0"), (), WIDTH))


@query
def interval_partition(spark, sf_dir):
    return _spans(intervals.partition(Tables(spark, sf_dir).cds, (), WIDTH))


@query
def interval_map_ids(spark, sf_dir):
    cds = Tables(spark, sf_dir).cds
    return _spans(intervals.map_ids(intervals.partition(cds, (), WIDTH), cds, "transcript"))


@query
def interval_group_identical(spark, sf_dir):
    return _spans(intervals.group_identical(Tables(spark, sf_dir).cds, "transcript"))


@query
def overlap_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = t.sample_regions.distinct()
    got = intervals.overlap_join(left, t.targets.filter("set_id = 0").select("contig", "start", "end", "interval_id"), (), WIDTH, "left", left.columns)
    return _spans(got).select("sample_id", "contig", "start_pos", "end_pos", "b_interval_id", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)).cast("bigint").alias("overlap"))


@query
def multi_sample_depth(spark, sf_dir):
    return _spans(intervals.multi_depth(Tables(spark, sf_dir).sample_regions, width=WIDTH))


@query
def multi_sample_sets(spark, sf_dir):
    """Segments with the list of their samples, of some 150 samples."""
    rows = Tables(spark, sf_dir).sample_regions.withColumn("sample", F.concat(F.lit("s"), F.col("sample_id").cast("string"), F.lit("-"), F.pmod("start", F.lit(19)).cast("string")))
    found = intervals.multi_sets(rows, "sample", width=WIDTH)
    return _spans(found).withColumn("samples", F.array_join("samples", ";"))


def _regions_to_annotate(t: Tables) -> DataFrame:
    return intervals.merge(t.sample_regions, (), WIDTH).select("contig", "start", "end")


@query
def region_annotation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(annotate.annotate(_regions_to_annotate(t), annotate.annotated_exons(t.cds), annotation_etl.introns(t.gene_model)))


@query
def cds_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(reports.cds_report(t.sample(), t.targets, t.cds)).withColumn("exon_id", F.col("exon_id").cast("bigint"))


@query
def cds_target_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # of all sets, so that a CDS has pieces in several targets, some of which overlap
    regions = t.targets.unionByName(t.targets.withColumns({"start": F.col("end") - 20, "end": F.col("end") + 5})).unionByName(t.targets.withColumns({"end": F.col("start") - 4, "start": F.col("start") - 12}))
    rows = reports.cds_report(t.sample(), t.targets, genes.cds_in_targets(t.cds, regions, WIDTH))
    return _spans(rows.withColumn("label", genes.exon_label(F.col("exon_id")))).drop("exon_id")


@query
def transcript_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return genes.transcript_coverage(reports.cds_report(t.sample(), t.targets, t.cds))


@query
def gene_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return genes.gene_coverage(genes.transcript_coverage(reports.cds_report(t.sample(), t.targets, t.cds)))


@query
def preferred_gene_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = genes.transcript_coverage(reports.cds_report(t.sample(), t.targets, t.cds))
    preferred = t.cds.filter("transcript like 'NR\\_%'").select("transcript").distinct()
    return genes.gene_coverage(genes.preferred_only(rows, preferred)).select("gene", "n_transcripts", "pct")


@query
def cohort_wgs_summary(spark, sf_dir):
    return reports.wgs_summary(roundtrips.Place(spark, sf_dir).cohort())


@query
def cohort_capture_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.capture_summary(roundtrips.Place(spark, sf_dir).cohort(), t.targets)


@query
def cohort_uniformity_metric(spark, sf_dir):
    return reports.uniformity_metric(roundtrips.Place(spark, sf_dir).cohort()).withColumns({c: F.col(c).cast("bigint") for c in ("mode", "peak_area", "total_area")})


@query
def cohort_gene_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    by = ["sample"]
    return genes.gene_coverage(genes.transcript_coverage(reports.cds_report(roundtrips.Place(spark, sf_dir).cohort(), t.targets, t.cds), by), by)


@query
def coverage_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cds = reports.cds_report(t.sample(), t.targets, t.cds)
    transcripts = genes.transcript_coverage(cds)
    # a seventh of the exons and transcripts is moved to contigs that don't count; genes have no contig
    odd = lambda df: F.when(F.col("length") % 7 == 0, F.concat("contig", F.when(F.col("length") % 2 == 0, "_alt").otherwise("_Random1"))).otherwise(F.col("contig")) if "contig" in df.columns else F.lit(None).cast("string")
    level = lambda df, name: df.select(F.lit(name).alias("level"), odd(df).alias("contig"), "pct")
    return stats.coverage_categories(level(cds, "exon").unionByName(level(transcripts, "transcript")).unionByName(level(genes.gene_coverage(transcripts), "gene")))


@query
def batch_recurrence(spark, sf_dir):
    return _spans(batch.recurrent(Tables(spark, sf_dir).sample_regions, 40, width=WIDTH))


@query
def batch_exon_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(reports.batch_exons(t.sample_regions, t.cds, 40, WIDTH)).withColumn("exon_id", F.col("exon_id").cast("bigint"))


@query
def batch_transcript_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return batch.transcript_coverage(reports.batch_exons(t.sample_regions, t.cds, 40, WIDTH))


@query
def batch_gene_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wanted = t.cds.select("gene").distinct().filter("gene <> 'Brand#11'")
    rows = batch.of_interest(reports.batch_exons(t.sample_regions, t.cds, 40, WIDTH), wanted)
    return batch.gene_coverage(batch.transcript_coverage(rows))


@query
def exon_explode(spark, sf_dir):
    rows = annotation_etl.exon_rows(Tables(spark, sf_dir).gene_model)
    return _spans(rows.select("name", "contig", "strand", "coding", F.col("exon_id").cast("bigint").alias("exon_id"), "start", "end", F.col("cds_length").cast("bigint").alias("cds_length")))


@query
def cds_coords(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = annotation_etl.cds_coordinates(t.gene_model, t.registry)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("cds_start", "cds_end", "exon_id")})


@query
def introns(spark, sf_dir):
    return _spans(annotation_etl.introns(Tables(spark, sf_dir).gene_model)).withColumn("intron_id", F.col("intron_id").cast("bigint"))


@query
def registry_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return annotation_etl.named(t.gene_model.select("name", "contig", F.col("tx_start").cast("bigint").alias("tx_start")), t.registry)


@query
def unique_names(spark, sf_dir):
    rows = annotation_etl.unique_names(Tables(spark, sf_dir).gene_model)
    return rows.select("name", "contig", F.col("tx_start").cast("bigint").alias("tx_start"))


@query
def exon_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(annotation_etl.exon_table(t.models, t.genes))


@query
def intron_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _spans(annotation_etl.intron_table(t.models, t.genes))


@query
def validate_intervals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    touching = validate.unmerged(t.sample_regions, ["sample_id"], WIDTH).select(F.lit("unmerged").alias("problem"), "contig", "start", "end")
    names = validate.wrong_contig_names(t.sample_regions, "hg37").select(F.lit("contig_name").alias("problem"), "contig", "start", "end")
    return _spans(touching.unionByName(names)).groupBy("problem", "contig").agg(F.count("*").alias("n"), F.sum("start_pos").alias("sum_start"))


@query
def annotated_contigs(spark, sf_dir):
    """Contigs of an annotation, with how much of it is on each of them."""
    cds = Tables(spark, sf_dir).cds
    return batch.contigs_of(cds).join(cds.groupBy("contig").agg(F.count("*").alias("n")), "contig")


@query
def overlap_report(spark, sf_dir):
    """What mate overlap takes from the whole-genome report."""
    rows = reports.wgs_summary(Tables(spark, sf_dir).sample(exclude_overlap=True))
    return rows.filter(F.col("metric").isin("Total_Mapped_Bases", "Total_Uniquely_Aligned_Bases", "Total_Overlapped_Aligned_Bases", "PCT_Overlapped_Aligned_Bases"))


@query
def depth_lines(spark, sf_dir):
    return sinks.depth_lines(Tables(spark, sf_dir).sample().rle())
