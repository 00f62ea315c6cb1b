"""Coverage percentages of coding exons (CDS), transcripts and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import JOIN_BIN, overlap_join

CDS = ["contig", "gene", "transcript", "exon_id", "start", "end"]


def _united(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bases, parts) of pieces (keys, lo, hi): bases of their union, and it as an array of disjoint (p0, p1) in order. All in
    one shuffle by the keys."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("__before", before).withColumn("__run", F.sum(F.when(F.col("lo") <= F.col("__before"), 0).otherwise(1)).over(w))
    joined = runs.groupBy(*keys, "__run").agg(F.min("lo").alias("p0"), F.max("hi").alias("p1"))
    return joined.groupBy(*keys).agg(F.sum(F.col("p1") - F.col("p0")).cast("bigint").alias("bases"), F.array_sort(F.collect_list(F.struct("p0", "p1"))).alias("parts"))


def _text(parts: str) -> Column:
    return F.array_join(F.transform(parts, lambda s: F.concat_ws("-", s["p0"].cast("string"), s["p1"].cast("string"))), ";")


def cds_in_targets(cds: DataFrame, targets: DataFrame, width: int = JOIN_BIN) -> DataFrame:
    """The distinct rows of cds that overlap targets, with `pieces` (what of them lies in targets, all pieces, as an array) and
    `targeted` (the bases of these). Targets that overlap or touch count once."""
    rows = cds.distinct()
    pairs = overlap_join(rows, targets.select("contig", "start", "end"), width=width)
    found = _united(pairs.select(*rows.columns, "lo", "hi"), rows.columns)
    return found.select(*rows.columns, F.col("bases").alias("targeted"), F.col("parts").alias("pieces"))


def exon_label(exon_id: Column) -> Column:
    """`cds_<number>`, or `_` for an exon without one (-1)."""
    return F.when(exon_id == -1, "_").otherwise(F.concat(F.lit("cds_"), exon_id.cast("string")))


def cds_coverage(cds: DataFrame, low: DataFrame, by: Sequence[str] = (), width: int = JOIN_BIN, samples: DataFrame | None = None) -> DataFrame:
    """(by, contig, gene, transcript, exon_id, start, end, length, low_bases, pct, low_regions) of each distinct CDS of a
    transcript; of several exon ids at one place the highest counts.

    `low` (by, contig, start, end) are the low runs inside the targets, so that bases outside of them count as covered; of rows
    from cds_in_targets only what lies in targets counts as length, and the pieces stay as a further column. An exon id of -1 has
    no number of its own; below -1 the exon was not designed, and its percentage is 0. With `by`, `samples` (distinct keys) says
    whose rows there are, also where nothing is low; it is a row for each sample.
    """
    more = ["targeted", "pieces"] if "pieces" in cds.columns else []
    rows = cds.groupBy(*(c for c in CDS if c != "exon_id")).agg(F.max("exon_id").alias("exon_id"), *(F.first(c).alias(c) for c in more)).select(*CDS, *more)
    keys = [*by, *CDS]
    pieces = overlap_join(rows.select(*CDS), low.select(*(F.col(c).alias(f"k_{c}") for c in by), "contig", "start", "end"), (), width)
    lows = _united(pieces.select(*(F.col(f"b_k_{c}").alias(c) for c in by), *CDS, "lo", "hi"), keys).withColumnRenamed("bases", "low_bases")
    if by:
        every = (samples if samples is not None else low).select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("__all"))  # one row
        rows = rows.join(F.broadcast(every)).select(*CDS, *more, F.explode("__all").alias("__key")).select("__key.*", *CDS, *more)
    size = (F.col("targeted") if more else F.col("end") - F.col("start")).cast("bigint")
    out = rows.join(lows, keys, "left").withColumns({"low_bases": F.coalesce("low_bases", F.lit(0)).cast("bigint"), "length": size})
    pct = F.when(F.col("exon_id") < -1, 0.0).otherwise((F.col("length") - F.col("low_bases")) * 100.0 / F.col("length"))
    low_text = F.when(F.col("exon_id") < -1, "NOT_Designed").otherwise(_text("parts"))
    return out.select(*keys, "length", "low_bases", pct.alias("pct"), low_text.alias("low_regions"), *([_text("pieces").alias("pieces")] if more else []))


def transcript_coverage(cds_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, contig, gene, transcript, length, n_cds, pct)."""
    lost = F.sum(F.when(F.col("exon_id") < -1, F.col("length")).otherwise(F.col("low_bases")))
    total = F.sum("length")
    return cds_rows.groupBy(*by, "contig", "gene", "transcript").agg(total.cast("bigint").alias("length"), F.count("*").alias("n_cds"), ((total - lost) * 100.0 / total).alias("pct"))


def preferred_only(transcripts: DataFrame, preferred: DataFrame) -> DataFrame:
    """Of genes with a preferred transcript only those; a suffix -n of a name does not count."""
    marked = transcripts.withColumn("__base", F.regexp_replace("transcript", "-[0-9]+$", ""))
    chosen = preferred.select(F.col("transcript").alias("__base")).distinct().withColumn("__is", F.lit(True))
    marked = marked.join(chosen, "__base", "left").withColumn("__any", F.max(F.col("__is")).over(Window.partitionBy("gene")))
    return marked.filter(F.col("__any").isNull() | F.col("__is")).drop("__base", "__is", "__any")


def gene_coverage(transcripts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gene, n_transcripts, pct, transcripts): mean over a gene's transcripts, on all contigs, and the list of them."""
    item = F.concat("transcript", F.lit("("), F.format_string("%.2f", F.floor(F.col("pct") * 100 + 0.5) / 100), F.lit(")"))
    return transcripts.groupBy(*by, "gene").agg(F.count("*").alias("n_transcripts"), F.avg("pct").alias("pct"), F.array_join(F.array_sort(F.collect_list(item)), ";").alias("transcripts"))


def gene_transcripts(cds: DataFrame) -> DataFrame:
    return cds.select("gene", "transcript").distinct()
