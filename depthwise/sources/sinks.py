"""Results in the formats that downstream tools read: tab-separated reports, dumps of depth, WIG."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.depth import base_depth
from ..operators.intervals import clipped_to_bins, overlap_join

#: Columns of the region report, and its header.
REGION_COLUMNS = ("contig", "start", "end", "length", "mean_depth", "genes", "synonyms", "prev", "refseq", "ccds", "vega", "mirna", "other")

REGION_HEADER = ("Chr", "Start", "End", "Length", "Coverage", "Gene_Symbol", "Synonyms", "Prev_Gene_Symbol", "RefSeq", "CCDS", "VEGA", "miRNA", "Others (SNP, Pseudo-Gene etc.)")


def depth_lines(rle: DataFrame, values: int = 100) -> DataFrame:
    """(contig, line, text): depths of the bases, `values` on a line, joined by spaces."""
    pieces = clipped_to_bins(rle.select("contig", "start", "end", "depth"), values).withColumnRenamed("bin", "line")
    listed = pieces.groupBy("contig", F.col("line").cast("bigint").alias("line")).agg(_repeated("start", "end", " "))
    return listed.select("contig", "line", "text")


def _repeated(start: str, end: str, between: str) -> Column:
    """The depths of all bases of a group's runs, in order."""
    runs = F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), "depth")))
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["depth"].cast("string"), (r["b"] - r["a"]).cast("int")))), between).alias("text")


def write_depth_lines(rle: DataFrame, path: str, values: int = 100) -> None:
    """Text files by contig, in order: a header line for each contig, then its depths."""
    lines = depth_lines(rle, values)
    headers = lines.select("contig").distinct().select("contig", F.lit(-1).cast("bigint").alias("line"), F.concat(F.lit(">"), "contig").alias("text"))
    rows = headers.unionByName(lines).repartitionByRange("contig", "line").sortWithinPartitions("contig", "line")
    rows.select(F.col("contig").alias("chromosome"), "text").write.partitionBy("chromosome").text(path)


def write_target_depth(on_target: DataFrame, path: str) -> None:
    """A row for each target base: contig, position, next position, depth."""
    rows = base_depth(on_target, ["set_id"]).select("set_id", "contig", "pos", (F.col("pos") + 1).alias("end"), "depth")
    rows.write.partitionBy("set_id").csv(path, sep="\t")


def dotted(df: DataFrame) -> DataFrame:
    """df as text, with a dot for null or empty."""
    return df.select(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", ".").otherwise(F.col(c).cast("string")).alias(c) for c in df.columns))


def write_regions(rows: DataFrame, path: str, contigs: DataFrame | None = None) -> None:
    """The 13-column region report as text, in order of contig (as in `contigs`, else by name), start and end over all files in
    order of their names, with one header line; columns that rows lack, nulls and empty values are dots. Sorted by range
    partitions, each of which writes one file."""
    full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REGION_COLUMNS))
    if contigs is not None:
        full = full.join(F.broadcast(contigs.select("contig", "ordinal")), "contig")  # a row for each contig
    place = [F.col("ordinal" if contigs is not None else "contig").alias("a"), F.col("start").cast("bigint").alias("b"), F.col("end").cast("bigint").alias("c")]
    text = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", ".").otherwise(F.col(c).cast("string"))
    lines = full.select(*place, F.concat_ws("\t", *map(text, REGION_COLUMNS)).alias("value"))
    kinds = ", ".join(f"{c} {k}" for c, k in lines.dtypes)
    head = rows.sparkSession.createDataFrame([(None, None, None, "##" + "\t".join(REGION_HEADER))], kinds)  # nulls sort first
    lines.unionByName(head).repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").select("value").write.text(path)


def report_lines(metrics: DataFrame, histogram: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """(by, place, value): metric<TAB>value lines; then the histogram on one line, after >>."""
    lines = metrics.select(*by, F.lit(0).alias("place"), F.concat_ws("\t", "metric", F.format_string("%.3f", "value")).alias("value"))
    if histogram is None:
        return lines
    values = F.transform(F.array_sort(F.collect_list(F.struct("depth", "n_bases"))), lambda s: s["n_bases"].cast("string"))  # of the capped depths
    return lines.unionByName(histogram.groupBy(*by).agg(F.lit(1).alias("place"), F.concat(F.lit(">>"), F.array_join(values, ",")).alias("value")))


def write_report(metrics: DataFrame, histogram: DataFrame | None, path: str) -> None:
    report_lines(metrics, histogram).select("value").write.text(path)


def write_reports(metrics: DataFrame, histogram: DataFrame | None, by: str, path: str) -> None:
    """The reports of a cohort: a folder <by>=<sample> with one file for each sample."""
    lines = report_lines(metrics, histogram, [by]).repartition(by).sortWithinPartitions(by, "place")
    lines.select(by, "value").write.partitionBy(by).text(path)


def write_coverage(rows: DataFrame, path: str) -> None:
    """CDS, transcript or gene percentages."""
    dotted(rows).write.csv(path, sep="\t", header=True)


def wig_lines(hot: DataFrame, rle: DataFrame, values: int = 1000) -> DataFrame:
    """(set_id, contig, start, piece, text): the depths of each off-target region, one on a line and at most `values` in a row; the
    first piece of a region has the fixedStep header."""
    pairs = overlap_join(hot.select("set_id", "contig", "start", "end"), rle.select("contig", "start", "end", "depth"))
    piece = lambda at: F.floor((at - F.col("start")) / values).cast("int")
    low = F.col("start") + F.col("piece") * values
    cut = pairs.withColumn("piece", F.explode(F.sequence(piece(F.col("lo")), piece(F.col("hi") - 1)))).withColumns({"lo": F.greatest("lo", low), "hi": F.least("hi", low + values)})
    listed = cut.withColumnRenamed("b_depth", "depth").groupBy("set_id", "contig", "start", "piece").agg(_repeated("lo", "hi", "\n"))
    head = F.concat(F.lit("fixedStep chrom_name="), "contig", F.lit(" start="), F.col("start").cast("string"), F.lit(" step=1"))
    return listed.select("set_id", "contig", "start", "piece", F.concat_ws("\n", F.when(F.col("piece") == 0, head), "text").alias("text"))


def write_wig(hot: DataFrame, rle: DataFrame, path: str) -> None:
    """Text files in a folder for each set, regions in order over all files."""
    place = ["set_id", "contig", "start", "piece"]
    wig_lines(hot, rle).repartitionByRange(*place).sortWithinPartitions(*place).select("set_id", "text").write.partitionBy("set_id").text(path)


def write_annotation(rows: DataFrame, path: str, files: int | None = None) -> None:
    """An annotation table as Parquet in a folder for each contig, so that readers see the contigs they want only. Rows are dealt by
    ranges of contig and start, to `files` tasks or as many as the session shuffles to: a large contig is written by several."""
    place = ["contig", "start"]
    dealt = rows.repartitionByRange(files, *place) if files else rows.repartitionByRange(*place)
    dealt.sortWithinPartitions(*place).write.partitionBy("contig").parquet(path)


def write_annotation_parts(segments: DataFrame, lists: DataFrame, path: str, files: int | None = None) -> None:
    """An annotation table in its two parts: the segments as by `write_annotation`, and beside them the lists that they share, each
    once. Put together, the text of a table can be many times as long."""
    write_annotation(segments, f"{path}/segments", files)
    lists.write.parquet(f"{path}/lists")
