"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depths for which bases are counted. 0 counts bases of exactly that depth, the others bases of at least it.
THRESHOLDS = (0, 1, 5, 6, 10, 11, 15, 20, 30, 40, 50, 60, 70, 100, 150, 500, 1000)
#: Contigs that the uniformity histogram leaves out.
SEX_CONTIGS = ("chrX", "chrY", "X", "Y", "CHRX", "CHRY")


def half_up(x: Column) -> Column:
    """x rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, halves upwards; 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part.cast("double") / whole.cast("double") * 10000 + 0.5) / 100)


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def plain_contig(contig: Column) -> Column:
    """The name without a leading chr."""
    return F.regexp_replace(contig, "(?i)^chr", "")


def primary(contig: Column) -> Column:
    """Whether a contig is no patch or alternative: its name has no underscore."""
    return ~contig.contains("_")


def source_of(name: Column, kind: Column | None = None) -> Column:
    """Where an annotation comes from, by its type and then by what its name contains, in any case."""
    low = F.lower(name)
    by_name = (
        F.when(low.contains("nm_") | low.contains("nr_") | low.contains("xm_"), "refseq")
        .when(low.contains("ccds") | low.contains("uc"), "ccds")
        .when(low.contains("ott") | low.contains("enst"), "vega")
        .when(low.contains("hsa-") | low.contains("mir"), "mirna")
        .otherwise("other")
    )
    if kind is None:
        return by_name
    return F.when(F.lower(kind).contains("snp"), "snp").when(F.lower(kind).contains("mirna"), "mirna").otherwise(by_name)


def peak_size(mean: Column) -> Column:
    """Histogram bins of the peak, by mean depth (fixed values)."""
    steps = ((20, 3), (25, 4), (30, 5), (35, 6), (55, 7), (70, 8), (85, 9), (100, 10), (110, 11), (120, 12))
    out = None
    for limit, size in steps:
        out = F.when(mean <= limit, size) if out is None else out.when(mean <= limit, size)
    return out.otherwise(13)
