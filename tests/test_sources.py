"""Readers, checks and sinks on small files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depthwise.sources import fixtures, readers, sinks, validate


def write(folder: Path, name: str, text: str) -> str:
    (folder / name).write_text(text)
    return str(folder / name)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\nr1\t99\tchr1\t11\t60\t5M\t=\t31\t25\tACGTA\tIIIII\tNM:i:0\tMC:Z:5M\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\nr3\t0\tchrUn\t1\t9\t3M\tchr1\t7\t0\tACG\t!!5\n"


def test_sam(spark, tmp_path):
    path = write(tmp_path, "s1.sam", SAM)
    contigs = readers.contigs_of_header(spark, path)
    assert rows(contigs) == [("chr1", 1000, 0), ("chr2", 500, 1)] and readers.genome_size(contigs).first()[0] == 1500
    df = readers.alignments(spark, path)
    assert rows(df, "contig", "pos", "cigar", "l_qseq", "mate_contig", "mate_pos", "isize", "mc") == sorted([("chr1", 10, "5M", 5, "chr1", 30, 25, "5M"), (None, -1, None, 3, None, -1, 0, None), ("chrUn", 0, "3M", 3, "chr1", 6, 0, None)], key=str)
    assert df.filter("contig = 'chrUn'").first().quals == [0, 0, 20] and df.first().sample_id == "s1.sam"
    assert rows(readers.alignments(spark, path, contigs), "contig") == [("chr1",), (None,)]


def test_beds(spark, tmp_path):
    path = write(tmp_path, "t.bed", "# targets\nchr1\t10\t20\nchr9\t0\t5\n\nchr1\t30\t44\n")
    contigs = readers.contigs_of_bed(spark, write(tmp_path, "c.bed", "chr1\t0\t100\nchr2\t0\t50\n"))
    assert rows(contigs) == [("chr1", 100, 0), ("chr2", 50, 1)]
    assert rows(readers.intervals(spark, path, contigs), "contig", "start", "end") == [("chr1", 10, 20), ("chr1", 30, 44)]
    notes = write(tmp_path, "a.bed", "chr1\t10\t20\tG|NM_1|cds_18|gene\nchr1\t30\t30\tH|NR_2|7|SNP\nchr1\t40\t50\tK|x|cds\n")
    assert rows(readers.annotations(spark, notes)) == [("chr1", 10, 20, "G", "NM_1", 18, "gene"), ("chr1", 29, 30, "H", "NR_2", 7, "SNP"), ("chr1", 40, 50, "K", "x", -1, "gene")]
    targets, annotated = readers.target_sets(spark, write(tmp_path, "pairs", f"{path} {notes}\n{tmp_path}/c.bed\n"))
    assert rows(targets.groupBy("set_id").count()) == [(0, 3), (1, 2)] and rows(annotated.groupBy("set_id").count()) == [(0, 3)]
    with pytest.raises(ValueError):
        readers.target_sets(spark, write(tmp_path, "twice", f"{path}\n{path}\n"))


def test_annotation_sources(spark, tmp_path):
    model = write(tmp_path, "m.tsv", "NM_1\tchr1\t+\t0\t100\t10\t90\t2\t0,60,\t40,100,\tGENE\n")
    m = readers.gene_models(spark, model).first()
    assert (m.exon_starts, m.exon_ends, m.symbol) == ([0, 60], [40, 100], "GENE")
    reg = write(tmp_path, "h.tsv", "hgnc_id\tsymbol\talias\tprev\tensembl\tvega\tucsc\trefseq\tccds\tmirbase\nHGNC:5\tA\t\"x|y\"\t\tENSG1\t\tuc1\tNM_1|NM_2\tCCDS1\t\n")
    h = readers.registry(spark, reg).first()
    assert (h.symbol, h["alias"], h.prev, h.refseq) == ("A", "x,y", None, "NM_1,NM_2")
    gff = write(tmp_path, "m.gff3", "##gff\nchr1\t.\tmiRNA_primary_transcript\t11\t30\t.\t+\t.\tID=MI1;Name=hsa-mir-1\n")
    assert rows(readers.mirna(spark, gff)) == [("chr1", 10, 30, "hsa-mir-1", 1, "miRNA", "MI1")]
    assert rows(readers.gene_list(spark, write(tmp_path, "g.txt", "A\nB\n\nA\n"))) == [("A",), ("B",)]
    spark.createDataFrame([("chr1", "NM_1.3")], "contig string, transcript string").write.parquet(f"{tmp_path}/tx")
    assert rows(readers.preferred_transcripts(readers.annotation_table(spark, f"{tmp_path}/tx", "chr1"))) == [("NM_1",)]


def test_report_sources(spark, tmp_path):
    write(tmp_path, "x.low", "#h\nchr1\t1\t5\t4\t2\tG\nchr1\t9\t12\t3\t1\tG\n")
    assert rows(readers.low_coverage_reports(spark, f"{tmp_path}/*.low")) == [("x.low", "chr1", 1, 5), ("x.low", "chr1", 9, 12)]
    blocks = write(tmp_path, "b.txt", "#h\nchr1\t0\t5\t5\t7\nchr2\t0\t3\t3\t1\n")
    assert rows(readers.coverage_blocks(spark, blocks, "chr1")) == [("chr1", 0, 5, 5, 7)]
    write(tmp_path, "y.rep", "#Base_Stats\nAverage_Coverage\t12.5\nPCT_of_Bases_with_10x_coverage\t97.25%\n>>1,2,5,\n==0,4,4,\n")
    metrics, histogram = readers.summary_reports(spark, f"{tmp_path}/*.rep")
    assert rows(metrics) == [("y.rep", "Average_Coverage", 12.5), ("y.rep", "PCT_of_Bases_with_10x_coverage", 97.25)]
    raw = histogram.filter("not smoothed")
    assert rows(raw, "depth", "n_bases") == [(0, 1), (1, 2), (2, 5)]
    shares = readers.histogram_shares(raw, metrics.filter("metric = 'Average_Coverage'").select("sample_id", F.col("value").alias("average")))
    assert rows(shares, "depth", "pct") == [(0, 12.5), (1, 25.0), (2, 62.5)]


def test_checks(spark):
    df = spark.createDataFrame([("chr1", 0, 5), ("chr1", 5, 9), ("2", 3, 4)], "contig string, start int, end int")
    assert rows(validate.wrong_contig_names(df, "hg38"), "contig") == [("2",)] and validate.wrong_contig_names(df, "hg37").count() == 2
    assert rows(validate.unmerged(df), "start") == [(5,)]
    assert validate.shares_contigs(df, spark.createDataFrame([("chr1",)], "contig string")).first().shared
    notes = spark.createDataFrame([("c", 1, 1, "a|b|c"), ("c", 1, 2, "a|b"), ("c", 1, 2, "a|b|c|d")], "contig string, start int, end int, annotation string")
    assert rows(validate.bad_annotations(notes), "problem") == [("empty interval",), ("too few fields",)]


def test_sinks(spark, tmp_path):
    rle = spark.createDataFrame([("c", 0, 0, 3, 1), ("c", 0, 3, 5, 7), ("d", 0, 0, 2, 0)], "contig string, bin int, start int, end int, depth int")
    sinks.write_depth_lines(rle, f"{tmp_path}/fa", 4)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/fa").collect()) == ["0 0", "1 1 1 7", "7", ">c", ">d"]
    hot = spark.createDataFrame([(0, "c", 2, 5)], "set_id int, contig string, start int, end int")
    assert sinks.wig_lines(hot, rle).first().text == "fixedStep chrom_name=c start=2 step=1\n1\n7\n7"
    sinks.write_wig(hot, rle, f"{tmp_path}/wig")
    sinks.write_regions(spark.createDataFrame([("c", 1, 5, 4, 2, None)], "contig string, start int, end int, length int, mean_depth int, genes string"), f"{tmp_path}/regions")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/regions").collect()]
    assert lines[0] == "##" + "\t".join(sinks.REGION_HEADER) and lines[1] == "c\t1\t5\t4\t2" + "\t." * 8
    metrics = spark.createDataFrame([("Average_Coverage", 12.5)], "metric string, value double")
    sinks.write_report(metrics, spark.createDataFrame([(0, 4), (1, 2)], "depth int, n_bases long"), f"{tmp_path}/report")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/report").collect()) == [">>4,2", "Average_Coverage\t12.500"]
    sinks.write_target_depth(rle.withColumn("set_id", F.lit(1)), f"{tmp_path}/bases")
    assert spark.read.csv(f"{tmp_path}/bases", sep="\t").count() == 7
    sinks.write_annotation(rle.drop("bin"), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").filter("contig = 'c'").count() == 2
    sinks.write_coverage(hot, f"{tmp_path}/cov")


def test_fixture_shapes(spark):
    at = "/root/testdata/sf0.001"
    if not Path(at).exists():
        pytest.skip("no test tables")
    assert fixtures.table(spark, at, "alignments").count() == 6000
    assert fixtures.table(spark, at, "targets").filter("set_id = 0").count() == 184
    assert validate.unmerged(fixtures.table(spark, at, "targets"), ["set_id"]).count() == 0
