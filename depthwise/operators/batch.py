"""Regions that are poorly covered in many samples, and what they take from exons, transcripts and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, JOIN_BIN, merge, overlap_join, runs, sample_sweep


def recurrence_threshold(regions: DataFrame, pct: float, sample: str = "sample_id") -> DataFrame:
    """(n_samples, threshold): the least number of samples, int(pct * samples / 100 + 0.4)."""
    n = F.countDistinct(sample)
    return regions.agg(n.alias("n_samples"), F.floor(n * pct / 100 + 0.4).cast("bigint").alias("threshold"))


def recurrent(regions: DataFrame, pct: float, sample: str = "sample_id", width: int = BIN) -> DataFrame:
    """(contig, start, end): where at least that share of the samples has a region, merged."""
    least = recurrence_threshold(regions, pct, sample).select("threshold")  # one row
    often = sample_sweep(regions, sample, width=width).join(F.broadcast(least)).filter(F.col("n_samples") >= F.col("threshold"))
    return runs(often.withColumn("kept", F.lit(True)), ["kept"], (), width).select("contig", "start", "end")


def exon_coverage(low: DataFrame, cds: DataFrame, width: int = JOIN_BIN) -> DataFrame:
    """(contig, gene, transcript, exon_id, start, end, length, low_bases, pct) of every annotated exon. Low bases are found by
    overlap and go to the exon by its id, within contig, gene and transcript."""
    keys = ["contig", "gene", "transcript", "exon_id"]
    rows = cds.filter(F.col("transcript") != ".").select(*keys, "start", "end").distinct()
    pieces = overlap_join(rows, low.select("contig", "start", "end"), (), width)
    merged = merge(pieces.select(F.struct(*keys).alias("exon"), "contig", F.col("lo").alias("start"), F.col("hi").alias("end")), ["exon"])
    lows = merged.groupBy("exon").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("low_bases")).select("exon.*", "low_bases")
    length = (F.col("end") - F.col("start")).cast("bigint")
    out = rows.join(lows, keys, "left").withColumn("low_bases", F.least(F.coalesce("low_bases", F.lit(0)), length).cast("bigint"))
    return out.select(*keys, "start", "end", length.alias("length"), "low_bases", ((length - F.col("low_bases")) * 100.0 / length).alias("pct"))


def of_interest(rows: DataFrame, genes: DataFrame | None) -> DataFrame:
    """Rows of the genes listed (column gene); all rows without a list."""
    return rows if genes is None else rows.join(genes.select("gene").distinct(), "gene", "left_semi")


def transcript_coverage(exons: DataFrame) -> DataFrame:
    total = F.sum("length")
    return exons.groupBy("contig", "gene", "transcript").agg(total.cast("bigint").alias("length"), F.count("*").alias("n_exons"), ((total - F.sum("low_bases")) * 100.0 / total).alias("pct"))


def gene_coverage(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("gene").agg(F.count("*").alias("n_transcripts"), F.avg("pct").alias("pct"))


def contigs_of(cds: DataFrame) -> DataFrame:
    return cds.select("contig").distinct()
