"""Checks of inputs. Each returns the offending rows; an empty result means all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import JOIN_BIN
from .readers import placed


def wrong_contig_names(df: DataFrame, version: str) -> DataFrame:
    """Rows whose contig isn't named as in the reference version: hg38 with chr, hg37 and hs37 without."""
    prefixed = F.lower("contig").startswith("chr")
    return df.filter(~prefixed if version.lower() in ("hg38", "grch38") else prefixed)


def shares_contigs(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row with shared: whether any contig of df is in `contigs`."""
    return df.select("contig").distinct().join(contigs.select("contig"), "contig", "left_semi").agg((F.count("*") > 0).alias("shared"))


def unmerged(df: DataFrame, by: Sequence[str] = (), width: int = JOIN_BIN) -> DataFrame:
    """Intervals that overlap or touch an earlier one of their key and contig. Each is looked at in the bin of its start, which all
    that reach it are dealt to."""
    bin_of = lambda c: F.floor(F.col(c) / width).cast("int")
    rows = df.withColumn("__bin", F.explode(F.sequence(bin_of("start"), F.greatest(bin_of("start"), bin_of("end")))))
    w = Window.partitionBy(*by, "contig", "__bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prev_end", F.max("end").over(w)).filter((F.col("__bin") == bin_of("start")) & (F.col("prev_end") >= F.col("start"))).drop("__bin")


def out_of_order(lines: DataFrame) -> DataFrame:
    """Lines (contig, start, with their place from readers.placed) that a sorted file can't have, with the problem: a start that
    isn't above that of the line before on the same contig, or a contig that comes again after another one.

    Lines are compared within their split, and a split's first line with the last one of the split before, for which there is one
    row for each split; contigs that come again are found among the lines where the contig changes.
    """
    split = ["__file", "__block"]
    dealt = lines.repartition(*split)
    line = F.struct("contig", "start")
    last = dealt.groupBy(*split).agg(F.max_by(line, "__row").alias("last"))
    last = last.withColumn("__edge", F.lag("last").over(Window.partitionBy("__file").orderBy("__block"))).drop("last")
    rows = dealt.withColumn("__own", F.lag(line).over(Window.partitionBy(*split).orderBy("__row"))).join(last, split)
    before = F.coalesce("__own", "__edge")
    again = before["contig"].isNull() | (before["contig"] != F.col("contig"))
    rows = rows.withColumns({"__new": again, "problem": F.when(~again & (before["start"] >= F.col("start")), "start not above the last")})
    place = F.struct("__block", "__row")
    first = rows.filter("__new").groupBy("__file", "contig").agg(F.min(place).alias("__first"))
    returned = rows.filter("__new").join(first, ["__file", "contig"]).filter(place > F.col("__first")).withColumn("problem", F.lit("contig comes again"))
    kept = [*lines.columns, "problem"]
    return rows.filter("problem is not null").select(*kept).unionByName(returned.select(*kept))


def annotation_problems(spark: SparkSession, path) -> DataFrame:
    """(file, contig, start, end, annotation, problem) of the lines of annotation files that are not well formed or not in order;
    comments and empty lines don't count. A line may have several problems."""
    lines = placed(spark.read.csv(path, schema="contig string, start int, end int, annotation string", sep="\t", comment="#")).filter("contig is not null")
    found = out_of_order(lines).unionByName(bad_annotations(lines))
    return found.select(F.col("__file").alias("file"), "contig", "start", "end", "annotation", "problem")


def bad_annotations(rows: DataFrame) -> DataFrame:
    """Rows (contig, start, end, annotation) with an empty interval or fewer than three fields in the annotation."""
    empty, few = F.col("start") >= F.col("end"), F.coalesce(F.size(F.filter(F.split("annotation", r"\|"), lambda x: x != "")), F.lit(0)) < 3
    problems = F.array_compact(F.array(F.when(empty, "empty interval"), F.when(few, "too few fields")))
    return rows.withColumn("problem", F.explode(problems))
