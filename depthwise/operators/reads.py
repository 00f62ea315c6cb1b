"""Alignments: filter cascade, counters, aligned blocks, base qualities, mate overlap, class against targets.

An alignment row has read_id (any key that tells reads apart), qname (for sampling only), contig, pos (0-based), mapq, flag, cigar, l_qseq, mate_contig,
mate_pos, isize, mc (the mate's CIGAR or null) and quals; `by` names further key columns such as a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has, percent
from ..storage import stored
from .intervals import JOIN_BIN, overlap_join

#: Beyond the end of any contig.
FAR = 2_000_000_000
#: Flag bits of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 256, 512, 1024, 2048


@dataclass(frozen=True)
class ReadOptions:
    """What counts as a usable read and a usable base."""

    min_map_qual: int = 0
    min_base_qual: int = 0
    fraction: float = 1.0
    seed: int = 0
    remove_duplicates: bool = True
    remove_supplementary: bool = True
    exclude_overlap: bool = False


def _drawn(fraction: float, seed: int) -> Column:
    """By a hash of the read's name, so that a repeated run keeps the same reads, whatever the order of files, and both of a pair."""
    digest = F.md5(F.concat_ws(":", "qname", F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") < int(fraction * (1 << 28))


def downsample(reads: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Reads kept with the given probability."""
    return reads if fraction >= 1 else reads.filter(_drawn(fraction, seed))


def staged(reads: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
    """reads with the stage of the cascade that each one ends in; "used" is what adds depth."""
    flag = F.col("flag")
    kept = _drawn(options.fraction, options.seed) if options.fraction < 1 else F.lit(True)
    stage = (
        F.when(~kept, "skipped").when(has(flag, UNMAPPED), "unmapped").when(F.col("mapq") < options.min_map_qual, "low_mapq")
        .when(has(flag, QC_FAIL), "qc_fail").when(has(flag, SECONDARY), "secondary")
    )
    if options.remove_duplicates:
        stage = stage.when(has(flag, DUPLICATE), "duplicate")
    if options.remove_supplementary:
        stage = stage.when(has(flag, SUPPLEMENTARY), "supplementary")
    return reads.withColumn("stage", stage.otherwise("used"))


def counters(reads: DataFrame, contigs: DataFrame, options: ReadOptions = ReadOptions(), by: Sequence[str] = ()) -> DataFrame:
    """Read counters in one scan, by `by` (all reads together if empty). Reads on contigs that aren't wanted are in none; reads
    without a contig count as produced only."""
    wanted = reads.join(F.broadcast(contigs.select("contig", "ordinal")), "contig", "left").filter(F.col("contig").isNull() | F.col("ordinal").isNotNull())
    rows = staged(wanted.withColumn("flag", F.when(F.col("contig").isNull(), F.col("flag").bitwiseOR(F.lit(UNMAPPED))).otherwise(F.col("flag"))), options)
    flag = F.col("flag")
    aligned = ~F.col("stage").isin("skipped", "unmapped", "low_mapq", "qc_fail", "secondary")
    past_duplicates = aligned & (F.col("stage") != "duplicate")
    count = lambda cond: F.count_if(cond)
    return rows.groupBy(*by).agg(
        F.count("*").alias("reads_produced"),
        count(aligned).alias("reads_aligned"),
        count(aligned & has(flag, PAIRED)).alias("reads_paired"),
        count(aligned & has(flag, PAIRED) & ~has(flag, MATE_UNMAPPED)).alias("paired_with_mapped_mate"),
        count(aligned & has(flag, DUPLICATE)).alias("duplicate_reads"),
        count(past_duplicates & has(flag, PROPER)).alias("proper_paired"),
        count(past_duplicates & ~has(flag, PROPER)).alias("chimeric_reads"),
        count(past_duplicates & has(flag, SUPPLEMENTARY)).alias("supplementary_reads"),
        F.coalesce(F.sum(F.when(aligned, F.col("l_qseq"))), F.lit(0)).cast("bigint").alias("mapped_bases"),
        F.min_by(F.when(F.col("stage") == "used", F.col("l_qseq")), F.when(F.col("stage") == "used", F.struct("ordinal", "pos", "l_qseq"))).cast("bigint").alias("read_length"),
    )


def read_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, value): counters with their shares of all reads (TR) and of the aligned ones (AR)."""
    total, aligned = F.col("reads_produced"), F.col("reads_aligned")
    rows = [("Total_Reads", total), ("Sequenced_Read_Length", F.col("read_length")), ("Total_Yield", F.col("read_length") * total), ("Aligned_Reads", aligned), ("PCT_Reads_Aligned", percent(aligned, total))]
    for name, value in (
        ("Unique_Aligned_Reads", aligned - F.col("duplicate_reads")), ("Duplicate_Reads", F.col("duplicate_reads")), ("Supplementary_Reads", F.col("supplementary_reads")), ("Paired_Reads", F.col("reads_paired")),
        ("Paired_Reads_With_Mapped_Mates", F.col("paired_with_mapped_mate")), ("Properly_Paired_Reads", F.col("proper_paired")), ("Chimeric_Reads", F.col("chimeric_reads")),
    ):
        rows += [(name, value), (f"PCT_of_{name}_TR", percent(value, total)), (f"PCT_of_{name}_AR", percent(value, aligned))]
    return metric_rows(counts, rows, by)


def metric_rows(df: DataFrame, rows: list[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """One row for each named value."""
    pairs = F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in rows))
    return df.select(*by, F.inline(pairs))


# ---- aligned blocks ------------------------------------------------------------------------------------------------------------

_CIGAR = "[0-9]+[MIDNSHPX=]"
#: Bound of the broadcast table of different CIGARs: their lengths and 64 bytes each.
CIGAR_BYTES = 16_000_000


def reference_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR consumes."""
    counts = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDNX=]"), F.lit(1))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n.cast("int"))


def cigar_pieces(cigar: Column) -> Column:
    """Array of (kind, r, q, n): aligned runs (kind M) and insertions (kind I) of a CIGAR, by their offsets on the reference and in
    the read. Neither hard clips nor padding move either."""
    none = F.expr("cast(array() as array<struct<kind:string,r:int,q:int,n:int>>)")

    def step(acc: Column, x: Column) -> Column:
        op, n, r, q = F.right(x, F.lit(1)), F.substring(x, F.lit(1), F.length(x) - 1).cast("int"), acc["r"], acc["q"]
        match, insert = op.isin("M", "X", "="), op == "I"
        piece = F.struct(F.when(match, "M").otherwise("I").alias("kind"), r.alias("r"), q.alias("q"), n.alias("n"))
        ref, query = F.when(match | op.isin("D", "N"), n).otherwise(0), F.when(match | insert | (op == "S"), n).otherwise(0)
        return F.struct((r + ref).alias("r"), (q + query).alias("q"), F.when(match | insert, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), none.alias("out"))
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(_CIGAR), F.lit(0)), start, step, lambda acc: acc["out"])


def cigar_forms(reads: DataFrame) -> DataFrame | None:
    """(cigar, pieces): the different CIGARs of reads, taken apart once each and written, to be broadcast; None if they have more
    bytes than CIGAR_BYTES. Short reads share few of them. To be made once for all that uses the same reads."""
    forms = stored(reads.filter(F.col("cigar").isNotNull()).select("cigar").distinct(), "cigars")
    if (forms.agg(F.sum(F.length("cigar") + 64)).first()[0] or 0) > CIGAR_BYTES:
        return None
    return stored(forms.withColumn("pieces", cigar_pieces(F.col("cigar"))), "cigars")


def blocks(used: DataFrame, contigs: DataFrame, keep: Sequence[str] = (), forms: DataFrame | None = None) -> DataFrame:
    """(keep, read_id, contig, kind, start, end, q_start, n): a row for each run of aligned bases (kind M, half-open on the
    contig and clipped to its end) and each insertion (kind I, start = end, n bases). With `forms` (cigar_forms of these reads or
    more) CIGARs are looked up, else each read's own is taken apart."""
    long = used.join(F.broadcast(contigs.select("contig", F.col("length").alias("clen"))), "contig")  # a row for each contig
    long = long.join(F.broadcast(forms), "cigar") if forms is not None else long.withColumn("pieces", cigar_pieces(F.col("cigar")))
    pieces = long.select(*keep, "read_id", "contig", "pos", "clen", F.inline("pieces")).filter(F.col("pos") + F.col("r") < F.col("clen"))
    start = F.col("pos") + F.col("r")
    end = F.when(F.col("kind") == "M", F.least(start + F.col("n"), F.col("clen"))).otherwise(start)
    return pieces.select(*keep, "read_id", "contig", "kind", start.alias("start"), end.alias("end"), F.col("q").alias("q_start"), "n")


def depth_blocks(used: DataFrame, contigs: DataFrame, options: ReadOptions = ReadOptions(), keep: Sequence[str] = (), forms: DataFrame | None = None) -> DataFrame:
    """(keep, contig, start, end) of what adds depth, after mate overlap and base quality where the options ask for them."""
    more = ["quals"] * (options.min_base_qual > 0)
    if not options.exclude_overlap:
        got = blocks(used, contigs, [*keep, *more], forms).filter("kind = 'M'")
    else:
        marked = mate_overlap(used).filter("not inside_mate")
        got = _outside(blocks(marked, contigs, [*keep, *more, "cut_from", "cut_to"], forms).filter("kind = 'M'"))
    if options.min_base_qual > 0:
        got = passing(got, options.min_base_qual)
    return got.select(*keep, "read_id", "contig", "start", "end", "q_start")


def passing(pieces: DataFrame, quality: int) -> DataFrame:
    """Maximal runs of bases of at least that quality in each block."""
    size = F.col("end") - F.col("start")
    good = lambda i: F.get("quals", F.col("q_start") + i) >= quality
    offsets = F.sequence(F.lit(0), size - 1)
    starts = F.filter(offsets, lambda i: good(i) & ((i == 0) | ~good(i - 1)))
    ends = F.filter(offsets, lambda i: good(i) & ((i == size - 1) | ~good(i + 1)))
    out = pieces.withColumn("__run", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))))
    a, b = F.col("__run.a"), F.col("__run.b")
    return out.withColumns({"start": F.col("start") + a, "end": F.col("start") + b + 1, "q_start": F.col("q_start") + a}).drop("__run")


# ---- mate overlap ----------------------------------------------------------------------------------------------------------------


def mate_overlap(reads: DataFrame, use_mate_cigar: bool = True) -> DataFrame:
    """reads with overlap_bases (bases shared with the mate, counted on one of the two only), the stretch [cut_from, cut_to) that
    adds no depth (nulls: none), and inside_mate.

    Only reads with a positive insert size and the mate on the same contig overlap. With the mate's CIGAR the overlap is
    exact. Without it the mate is taken to reach from its start to the end of this read; a read that starts after its mate is
    cut whole. A read inside its mate is dropped; that needs the mate's end.
    """
    pos, mate = F.col("pos"), F.col("mate_pos")
    end = pos + reference_length(F.col("cigar"))
    mate_end = mate + reference_length(F.col("mc"))
    paired = (F.col("isize") > 0) & (F.col("contig") == F.col("mate_contig"))
    known = paired & (F.col("mc").isNotNull() if use_mate_cigar else F.lit(False))
    exact = known & (end > mate) & (mate_end > pos)
    guess = paired & ~known & (((pos <= mate) & (mate < end)) | (pos > mate))
    shared = F.when(exact, F.least(end, mate_end) - F.greatest(pos, mate)).when(guess, end - F.greatest(pos, mate)).otherwise(0)
    return reads.withColumns({
        "overlap_bases": shared,
        "cut_from": F.when(exact | guess, mate),
        "cut_to": F.when(exact, mate_end).when(guess, F.lit(FAR)),
        "inside_mate": F.coalesce(known & (mate <= pos) & (end <= mate_end), F.lit(False)),
    })


def _outside(pieces: DataFrame) -> DataFrame:
    """What is left of blocks outside of [cut_from, cut_to): none, one or two pieces."""
    start, end = F.col("start"), F.col("end")
    low, high = F.coalesce("cut_from", end), F.coalesce("cut_to", end)
    left = F.struct(start.alias("start"), F.least(end, low).alias("end"), F.col("q_start").alias("q_start"))
    at = F.greatest(start, high)
    right = F.struct(at.alias("start"), end.alias("end"), (at - start + F.col("q_start")).alias("q_start"))
    kept = F.filter(F.array(left, right), lambda s: s["start"] < s["end"])
    rest = [c for c in pieces.columns if c not in ("start", "end", "q_start", "cut_from", "cut_to")]
    return pieces.select(*rest, F.inline(kept))


def quality_counts(used: DataFrame, contigs: DataFrame, options: ReadOptions = ReadOptions(), by: Sequence[str] = (), forms: DataFrame | None = None) -> DataFrame:
    """(by, q20_bases, q30_bases, q40_bases, aligned_bases): bases of quality at least 20, 30 and 40, over aligned and inserted
    bases, and the aligned ones, whatever the minimum base quality; aligned bases in a mate overlap don't count, inserted ones
    always do."""
    if options.exclude_overlap:
        found = blocks(mate_overlap(used).filter("not inside_mate"), contigs, [*by, "quals", "cut_from", "cut_to"], forms)
        aligned = _outside(found.filter("kind = 'M'"))
        pieces = aligned.select(*by, "kind", "quals", "q_start", (F.col("end") - F.col("start")).alias("n")).unionByName(found.filter("kind = 'I'").select(*by, "kind", "quals", "q_start", "n"))
    else:
        found = blocks(used, contigs, [*by, "quals"], forms)
        pieces = found.select(*by, "kind", "quals", "q_start", F.when(F.col("kind") == "M", F.col("end") - F.col("start")).otherwise(F.col("n")).alias("n"))
    # a row for each base, summed before it leaves the task
    bases = pieces.select(*by, (F.col("kind") == "M").alias("aligned"), F.explode(F.slice("quals", F.col("q_start") + 1, F.col("n"))).alias("q"))
    return bases.groupBy(*by).agg(*(F.count_if(F.col("q") >= t).alias(f"q{t}_bases") for t in (20, 30, 40)), F.count_if("aligned").alias("aligned_bases"))


# ---- targets -----------------------------------------------------------------------------------------------------------------------


def target_classes(used: DataFrame, contigs: DataFrame, targets: DataFrame, buffers: DataFrame, options: ReadOptions = ReadOptions(), width: int = JOIN_BIN, by: Sequence[str] = (), forms: DataFrame | None = None) -> DataFrame:
    """(by, set_id, on_target, in_buffer, off_target): reads by set; a read is on target if any of its aligned bases is, else in
    the buffer if any is, else off target. Bases count whatever their quality or mate overlap; reads inside their mate don't."""
    rows = mate_overlap(used).filter("not inside_mate") if options.exclude_overlap else used
    aligned = blocks(rows, contigs, by, forms).filter("kind = 'M'").select(*by, "read_id", "contig", "start", "end")
    regions = targets.select("set_id", "contig", "start", "end", F.lit(2).alias("rank")).unionByName(buffers.select("set_id", "contig", "start", "end", F.lit(1).alias("rank")))
    best = overlap_join(aligned, regions, width=width).groupBy(*by, "read_id", "b_set_id").agg(F.max("b_rank").alias("rank"))
    hits = best.groupBy(*by, F.col("b_set_id").alias("set_id")).agg(F.count_if(F.col("rank") == 2).alias("on_target"), F.count_if(F.col("rank") == 1).alias("in_buffer"))
    total = rows.join(F.broadcast(contigs.select("contig")), "contig", "left_semi").groupBy(*by).agg(F.count("*").alias("reads"))
    sets = targets.select("set_id").distinct().join(F.broadcast(total))  # a row for each set and sample
    every = sets.join(hits, [*by, "set_id"], "left").na.fill(0, ["on_target", "in_buffer"])
    return every.select(*by, "set_id", "on_target", "in_buffer", (F.col("reads") - F.col("on_target") - F.col("in_buffer")).alias("off_target"))
