"""Readers of the text formats and of their Parquet forms. Paths may be lists or globs; nothing is collected."""

from __future__ import annotations

from itertools import takewhile
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.annotation_etl import whole_table

BED = "contig string, start int, end int"


def _tsv(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", comment="#", mode="PERMISSIVE")


def alignments(spark: SparkSession, path, contigs: DataFrame | None = None) -> DataFrame:
    """SAM text -> alignments, with the sample (file) each read comes from. Reads without a contig stay, with a null contig. The
    read_id is made of the name, the flag and the place, so that it does not depend on files or splits."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    tags = F.filter(F.slice(f, F.lit(12), F.size(f)), lambda t: t.startswith("MC:Z:"))
    quals = F.get(f, F.lit(10))
    values = F.when(quals == "*", F.expr("cast(array() as array<tinyint>)")).otherwise(F.transform(F.split(quals, ""), lambda c: (F.ascii(c) - 33).cast("tinyint")))
    known = lambda i: F.when(F.get(f, F.lit(i)) != "*", F.get(f, F.lit(i)))
    whole = lambda i: F.get(f, F.lit(i)).cast("int")
    rows = lines.select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("sample_id"), F.concat_ws(":", F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2)), F.get(f, F.lit(3))).alias("read_id"), F.get(f, F.lit(0)).alias("qname"),
        known(2).alias("contig"), (whole(3) - 1).alias("pos"), whole(4).alias("mapq"), whole(1).alias("flag"), known(5).alias("cigar"),
        F.when(F.get(f, F.lit(9)) == "*", 0).otherwise(F.length(F.get(f, F.lit(9)))).alias("l_qseq"),
        F.when(F.get(f, F.lit(6)) == "=", known(2)).otherwise(known(6)).alias("mate_contig"), (whole(7) - 1).alias("mate_pos"), whole(8).alias("isize"),
        F.when(F.size(tags) > 0, F.substr(F.get(tags, F.lit(0)), F.lit(6))).alias("mc"), values.alias("quals"),
    )
    if contigs is None:
        return rows
    return rows.join(F.broadcast(contigs.select(F.col("contig").alias("__c"))), F.col("contig") == F.col("__c"), "left").filter("contig is null or __c is not null").drop("__c")


def placed(rows: DataFrame) -> DataFrame:
    """rows read from files, with the columns __file, __block (where the split starts) and __row (place within the task), which
    give their order in the file: by block and then by row."""
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))


def with_line_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows read from files, numbered from 0 over all files in order of their paths, however they are split: within each split,
    plus the rows of the splits before it, of which there is one row each."""
    split = ["__file", "__block"]
    dealt = placed(rows).repartition(*split)
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    first = dealt.groupBy(*split).agg(F.count("*").alias("n")).select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("__row")) - 1
    return dealt.withColumn("__at", inside).join(first, split).withColumn(name, F.col("__first") + F.col("__at")).drop(*split, "__row", "__at", "__first")


def _header_lines(spark: SparkSession, file: str, first: int = 256) -> list[str]:
    """The lines of a file before the first one without @. A small job that stops after so many lines of the file's first split;
    only a longer header takes another one."""
    while True:
        lines = [r.value for r in spark.read.text(file).take(first)]
        header = list(takewhile(lambda x: x.startswith("@"), lines))
        if len(header) < len(lines) or len(lines) < first:
            return header
        first *= 8


def contigs_of_header(spark: SparkSession, path) -> DataFrame:
    """Contig list of the @SQ lines of SAM files, in their order, files in order of their paths; a contig of several files counts
    once. Nothing behind a header is read. The list is held by the driver, as a manifest is: a row for each contig."""
    found: dict[str, int] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        for line in _header_lines(spark, unquote(file)):
            fields = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            if line.startswith("@SQ") and "SN" in fields:
                found.setdefault(fields["SN"], int(fields.get("LN", 0)))
    return spark.createDataFrame([(c, n, k) for k, (c, n) in enumerate(found.items())], "contig string, length bigint, ordinal int")


def contigs_of_bed(spark: SparkSession, path) -> DataFrame:
    """Contig list of BED files; length is end - start."""
    rows = with_line_numbers(_tsv(spark, path, BED), "at").filter("contig is not null")
    return _numbered(rows.select("at", "contig", (F.col("end") - F.col("start")).cast("bigint").alias("length")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Contigs are few: one row each, ordered in one task."""
    first = rows.groupBy("contig").agg(F.min("at").alias("at"), F.min_by("length", "at").alias("length"))
    return first.select("contig", "length", F.expr("cast(row_number() over (order by at) - 1 as int)").alias("ordinal"))


def genome_size(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.sum("length").cast("bigint").alias("genome_size"))


def intervals(spark: SparkSession, path, contigs: DataFrame | None = None) -> DataFrame:
    """Intervals of BED files, on the contigs wanted; interval_id counts the rows of all files, whatever the splits."""
    rows = with_line_numbers(_tsv(spark, path, BED), "interval_id").filter("contig is not null")
    return rows if contigs is None else rows.join(F.broadcast(contigs.select("contig")), "contig", "left_semi")


def annotation_columns(annotation: Column) -> list[Column]:
    """gene, transcript, exon_id, type of `gene|transcript|cds_N|type`; the exon's number may stand alone, without one it is -1."""
    f = F.split(annotation, r"\|")
    number = F.regexp_extract(F.coalesce(F.get(f, F.lit(2)), F.lit("")), "(-?[0-9]+)$", 1)
    return [F.get(f, F.lit(0)).alias("gene"), F.get(f, F.lit(1)).alias("transcript"), F.when(number == "", -1).otherwise(number.try_cast("int")).alias("exon_id"), F.coalesce(F.get(f, F.lit(3)), F.lit("gene")).alias("type")]


def _annotated(rows: DataFrame, *more: str) -> DataFrame:
    start = F.when(F.col("start") == F.col("end"), F.col("start") - 1).otherwise(F.col("start"))
    return rows.filter("contig is not null").select("contig", start.alias("start"), "end", *annotation_columns(F.col("annotation")), *more)


def annotations(spark: SparkSession, path) -> DataFrame:
    """(contig, start, end, gene, transcript, exon_id, type); an empty interval is widened by one base to the left."""
    return _annotated(_tsv(spark, path, BED + ", annotation string"))


def manifest_lines(spark: SparkSession, manifest) -> list[list[str]]:
    """[target] or [target, annotation] of each line of a manifest; it is read by the driver. If any line has a tab, tabs separate
    and names may have spaces, else spaces do."""
    texts = [r.value.rstrip("\r") for r in spark.read.text(manifest).collect() if r.value.strip() and not r.value.startswith("#")]
    lines = [x.split("\t") for x in texts] if any("\t" in x for x in texts) else [x.split() for x in texts]
    if any(not x[0].strip() for x in lines):
        raise ValueError("an annotation file without a target file in the manifest")
    if len({x[0] for x in lines}) < len(lines):
        raise ValueError("a target file occurs twice in the manifest")
    return [[f for f in x[:2] if f.strip()] for x in lines]


def _by_file(spark: SparkSession, rows: DataFrame, sets: list[tuple[str, int]]) -> DataFrame:
    """rows (of a read of all the paths of `sets`) with the set_id of each path that its file belongs to; a path may be a folder.
    Files are listed as Spark names them and matched by equality; one that serves several sets gives its rows to each."""
    one_form = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")  # noqa: E731  file:/ and file:/// are the same
    files = [(f, k) for path, k in sets for f in spark.read.text(path).inputFiles()]
    listed = spark.createDataFrame(files, "__file string, set_id int").withColumn("__file", one_form(F.col("__file")))
    return rows.withColumn("__file", one_form(F.col("__file"))).join(F.broadcast(listed), "__file").drop("__file", "__block", "__row")


def target_sets(spark: SparkSession, manifest) -> tuple[DataFrame, DataFrame | None]:
    """(targets, annotations) of a manifest with a target file and perhaps an annotation file on each line, each row with the
    set_id of its line. The files are read in one read each of targets and annotations; a target file may occur once, an
    annotation file often. Without annotation files there are no annotations (None). interval_id counts within a set's files."""
    lines = manifest_lines(spark, manifest)
    sets, pairs = [(x[0], k) for k, x in enumerate(lines)], [(x[1], k) for k, x in enumerate(lines) if len(x) > 1]
    beds = placed(_tsv(spark, [x for x, _ in sets], BED)).filter("contig is not null")
    number = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__row")) - 1
    # splits of a file start at different bytes, and a split has no more rows than bytes, so that this tells the rows of a file apart
    targets = _by_file(spark, beds.withColumn("interval_id", F.col("__block") + number), sets)
    if not pairs:
        return targets, None
    texts = placed(_tsv(spark, sorted({x for x, _ in pairs}), BED + ", annotation string"))
    return targets, _by_file(spark, _annotated(texts, "__file", "__block", "__row"), pairs)


def annotation_table(spark: SparkSession, path: str | None = None, contig: str | None = None, **jdbc) -> DataFrame:
    """An annotation table from Parquet, or from a database with the options of the JDBC source; a contig is a pushed filter. A
    table of write_annotation that is joined by contig is read for the contigs of the other side only."""
    df = spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()
    return df if contig is None else df.filter(F.col("contig") == contig)


def annotation_table_of_parts(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """An annotation table of write_annotation_parts, with the lists in its rows again; of the contigs of `contigs` (contig, a row for
    each) only, if given, whose folders alone are read."""
    segments = annotation_table(spark, f"{path}/segments")
    if contigs is not None:
        segments = segments.join(F.broadcast(contigs.select("contig")), "contig")
    return whole_table(segments, spark.read.parquet(f"{path}/lists"))


def preferred_transcripts(df: DataFrame, name: str = "transcript") -> DataFrame:
    """Transcript names without their version."""
    return df.select(F.substring_index(name, ".", 1).alias("transcript")).distinct()


def gene_models(spark: SparkSession, path) -> DataFrame:
    schema = "name string, contig string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exon_count int, s string, e string, symbol string"
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    return _tsv(spark, path, schema).select("name", "contig", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", numbers("s").alias("exon_starts"), numbers("e").alias("exon_ends"), "symbol")


def registry(spark: SparkSession, path) -> DataFrame:
    """Gene name registry; empty fields are null, lists are comma-joined."""
    names = ("hgnc_id", "symbol", "alias", "prev", "ensembl", "vega", "ucsc", "refseq", "ccds", "mirbase")
    rows = _tsv(spark, path, ", ".join(f"{n} string" for n in names))
    clean = lambda c: F.when(F.trim(c) != "", F.replace(F.regexp_replace(F.col(c), '"', ""), F.lit("|"), F.lit(",")))
    return rows.select(*(clean(c).alias(c) for c in names)).filter("hgnc_id <> 'hgnc_id'")


def mirna(spark: SparkSession, path) -> DataFrame:
    """miRNA annotations of a GFF3 file."""
    rows = _tsv(spark, path, "contig string, source string, kind string, s int, e int, score string, strand string, phase string, attributes string").filter("kind like 'miRNA%'")
    attributes = F.str_to_map("attributes", F.lit(";"), F.lit("="))
    return rows.select("contig", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), attributes["Name"].alias("transcript"), F.lit(1).alias("exon_id"), F.lit("miRNA").alias("type"), attributes["ID"].alias("gene"))


def gene_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("gene")).filter("gene <> ''").distinct()


def low_coverage_reports(spark: SparkSession, path, folders: bool = False) -> DataFrame:
    """(sample_id, contig, start, end) of many samples' region reports; the sample is the name of the file, or of its folder."""
    rows = _tsv(spark, path, BED).filter("start is not null")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2 if folders else -1).alias("sample_id"), "contig", "start", "end")


def region_reports(spark: SparkSession, path) -> DataFrame:
    """(line, 13 columns) of region reports, in the order of their lines; dots are nulls."""
    names = ("contig", "start", "end", "length", "mean_depth", "genes", "synonyms", "prev", "refseq", "ccds", "vega", "mirna", "other")
    rows = with_line_numbers(spark.read.text(path), "line").filter(~F.col("value").startswith("#"))
    fields = F.split("value", "\t")
    value = lambda k: F.when(F.get(fields, F.lit(k)) != ".", F.get(fields, F.lit(k)))
    return rows.select("line", *(value(k).cast("bigint" if 0 < k < 5 else "string").alias(c) for k, c in enumerate(names)))


def coverage_blocks(spark: SparkSession, path, contig: str | None = None) -> DataFrame:
    """(contig, start, end, length, mean_depth) of block reports; folders <name>=<sample> below the path give a further column."""
    rows = _tsv(spark, path, BED + ", length int, mean_depth bigint")
    return rows if contig is None else rows.filter(F.col("contig") == contig)


def summary_reports(spark: SparkSession, path, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of many samples' summary reports: (sample_id, metric, value), and (sample_id, smoothed, depth, n_bases) from the histogram
    lines (>> as counted, == smoothed). The sample is the name of the file, or of its folder."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -2 if folders else -1).alias("sample_id"), "value")
    metrics = lines.filter(F.col("value").rlike("^[^#>=\t]+\t")).select("sample_id", F.split("value", "\t")[0].alias("metric"), F.regexp_replace(F.split("value", "\t")[1], "%", "").try_cast("double").alias("value"))
    numbers = lines.filter(F.col("value").rlike("^(>>|==)"))
    items = F.filter(F.split(F.substr("value", F.lit(3)), ","), lambda x: x != "")
    return metrics, numbers.select("sample_id", F.col("value").startswith("==").alias("smoothed"), F.posexplode(items).alias("depth", "n")).select("sample_id", "smoothed", "depth", F.col("n").cast("bigint").alias("n_bases"))


def histogram_shares(histogram: DataFrame, average: DataFrame) -> DataFrame:
    """(sample_id, depth, pct) up to the x-axis limit that goes with the sample's average depth (column average)."""
    limit = F.when(F.col("average") <= 30, 60)  # fixed values: up to such an average, an axis that long
    for mean, end in ((55, 100), (80, 150), (120, 200), (160, 250)):
        limit = limit.when(F.col("average") <= mean, end)
    rows = histogram.withColumn("pct", F.col("n_bases") * 100.0 / F.sum("n_bases").over(Window.partitionBy("sample_id"))).join(F.broadcast(average), "sample_id")
    return rows.filter(F.col("depth") <= limit.otherwise(300)).select("sample_id", "depth", "pct")

