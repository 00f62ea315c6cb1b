"""Operators against plain Python on random and hand-made inputs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from depthwise.operators import annotate, annotation_etl, batch, depth, genes, intervals, reads, runs, stats, uniformity
from depthwise.operators.reads import ReadOptions

SPANS = "contig string, start int, end int"


def spans(spark, rows, schema=SPANS):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def random_spans(seed, n, length=900):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randrange(length)
        out.append((r.choice(["c1", "c2"]), s, min(length, s + r.randint(1, 70))))
    return out


def positions(rows):
    return {(c, p) for c, s, e in rows for p in range(s, e)}


def maximal(cells):
    """Maximal runs of a set of (contig, position)."""
    out = []
    for c, p in sorted(cells):
        if out and out[-1][0] == c and out[-1][2] == p:
            out[-1] = (c, out[-1][1], p + 1)
        else:
            out.append((c, p, p + 1))
    return out


@pytest.mark.parametrize("width", [64, 1 << 20])
def test_set_operators(spark, width):
    a, b = random_spans(1, 60), random_spans(2, 25)
    da, db = spans(spark, a), spans(spark, b)
    assert got(intervals.merge(da, width=width)) == maximal(positions(a))
    assert got(intervals.subtract(da, db, width=width)) == maximal(positions(a) - positions(b))
    assert got(intervals.merge(intervals.merge(da, width=width), width=width)) == maximal(positions(a))
    pairs = [(*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert got(intervals.overlap_join(da, db, width=width), "contig", "start", "end", "b_start", "b_end") == sorted(pairs)
    assert got(intervals.intersect(da, db, width=width)) == sorted((c, max(s, t), min(e, f)) for c, s, e, t, f in pairs)
    cuts = defaultdict(set)
    for c, s, e in a:
        cuts[c] |= {s, e}
    want = []
    for c, points in cuts.items():
        points = sorted(points)
        for s, e in zip(points, points[1:]):
            n = sum(1 for x in a if x[0] == c and x[1] <= s and x[2] >= e)
            if n:
                want.append((c, s, e, n))
    assert got(intervals.partition(da, width=width)) == sorted(want)
    taken = positions(b)
    pieces = [(c, p, p + 1) for c, s, e, _ in want for p in range(s, e) if (c, p) not in taken]
    left, starts = [], {(c, s) for c, s, _, _ in want}
    for c, p, q in sorted(pieces):  # cuts of a stay, what b covers is gone
        if left and left[-1][0] == c and left[-1][2] == p and (c, p) not in starts:
            left[-1] = (c, left[-1][1], q)
        else:
            left.append((c, p, q))
    assert got(intervals.partition(da, width=width, outside=db), "contig", "start", "end") == left


def test_left_join_keeps_rows_without_partner(spark):
    a = spans(spark, [(1, "c", 0, 10), (2, "c", 50, 60), (3, "d", 0, 5)], "id int, contig string, start int, end int")
    b = spans(spark, [("c", 5, 8), ("c", 9, 12)])
    rows = intervals.overlap_join(a, b, how="left", ids=["id"]).select("id", "b_start", "lo", "hi").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 5, 5, 8), (1, 9, 9, 10), (2, None, None, None), (3, None, None, None)]


@pytest.mark.parametrize("width", [50, 1 << 20])
def test_depth(spark, width):
    rows, n = random_spans(3, 80), [("c1", 100, 180), ("c2", 0, 40)]
    contigs = spark.createDataFrame([("c1", 900, 0), ("c2", 900, 1), ("c3", 70, 2)], "contig string, length int, ordinal int")
    rle = depth.depth_rle(spans(spark, rows), contigs, width=width, n_regions=spans(spark, n))
    count = Counter(p for c, s, e in rows for p in ((c, x) for x in range(s, e)))
    masked = positions(n)
    want = {(c, p): 0 if (c, p) in masked else count[(c, p)] for c, length in (("c1", 900), ("c2", 900), ("c3", 70)) for p in range(length)}
    assert {(r.contig, r.pos): r.depth for r in depth.base_depth(rle).collect()} == want
    assert rle.agg(F.sum(F.col("depth") * (F.col("end") - F.col("start")))).first()[0] == sum(want.values())
    low = got(runs.low_runs(rle, 2, width=width), "contig", "start", "end", "mean_depth")
    expected = maximal({k for k, d in want.items() if d < 2})
    assert low == [(c, s, e, int(sum(want[(c, p)] for p in range(s, e)) / (e - s) + 0.5)) for c, s, e in expected]
    blocks = got(uniformity.classed_blocks(rle, 1, 3, width=width), "contig", "class", "start", "end")
    kind = lambda d: 0 if d < 1 else 1 if d <= 3 else 2
    assert blocks == sorted((c, k, s, e) for k in range(3) for c, s, e in maximal({x for x, d in want.items() if kind(d) == k}))


def test_greedy_split_matches_a_walk_over_bases(spark):
    r = random.Random(4)
    values = [r.choice([0, 2, 12, 15, 25, 40, 90]) for _ in range(300)]
    rle = spans(spark, [("c", k, k + 1, v, k // 64) for k, v in enumerate(values)], SPANS + ", depth long, bin int")
    want, k = [], 0
    while k < 300:
        kind = lambda d: 0 if d < 1 else 1 if d <= 10 else 2
        j, low, high = k, values[k], values[k]
        while j < 300 and kind(values[j]) == kind(values[k]) and (kind(values[k]) < 2 or max(high, values[j]) <= 2 * min(low, values[j])):
            low, high, j = min(low, values[j]), max(high, values[j]), j + 1
        want.append(("c", k, j, int(sum(values[k:j]) / (j - k) + 0.5)))
        k = j
    assert got(uniformity.gvcf_blocks(rle, 1, 10, 2, width=64), "contig", "start", "end", "mean_depth") == want


def walk(h, mode, k):
    """Area of the peak, step by step."""
    area, left, right, count = h[mode], mode - 1, mode + 1, 1
    at = lambda i: h[i] if 0 < i < len(h) else 0
    while count < k and (at(left) or at(right)):
        a, b = at(left), at(right)
        if a > b:
            area, left, count = area + a, left - 1, count + 1
        elif b > a:
            area, right, count = area + b, right + 1, count + 1
        elif k - count >= 2:
            area, left, right, count = area + 2 * b, left - 1, right + 1, count + 2
        else:
            area, right, count = area + b, right + 1, count + 1
    return area


def test_uniformity_metric(spark):
    r = random.Random(7)
    for mean in (10, 27.5, 60, 130):
        h = [500] + [r.choice([0, 3, 3, 7, 9]) for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(h)), "depth long, n_bases long")
        facts = spark.createDataFrame([(float(mean), 20, 5, 3)], "mean_depth double, n_total long, n_x long, n_y long")
        x = uniformity.metric(df, facts).first()
        k = {10: 3, 27.5: 5, 60: 8, 130: 13}[mean]
        mode = max(range(1, 41), key=lambda d: (h[d], -d))
        assert (x["mode"], x.peak_area, x.total_area) == (mode, walk(h, mode, k), sum(h) - 20 + 8)


READ = "read_id long, contig string, pos int, mapq int, flag int, cigar string, l_qseq int, mate_contig string, mate_pos int, isize int, mc string, quals array<tinyint>"


def read(i, pos, cigar="10M", flag=3, mapq=60, mate=100, isize=0, mc=None, n=10, quals=None, contig="c"):
    return (i, contig, pos, mapq, flag, cigar, n, contig, mate, isize, mc, quals or [30] * n)


CONTIGS = [("c", 200, 0), ("d", 50, 1)]


def tables(spark, rows):
    return spark.createDataFrame(rows, READ), spark.createDataFrame(CONTIGS, "contig string, length int, ordinal int")


def test_cascade_and_counters(spark):
    rows = [read(1, 0), read(2, 0, flag=4), read(3, 0, mapq=5), read(4, 0, flag=512), read(5, 0, flag=256), read(6, 0, flag=1024 | 3), read(7, 0, flag=2048 | 1), read(8, 0, flag=1 | 8), read(9, 0, contig="unwanted")]
    df, contigs = tables(spark, rows)
    x = reads.counters(df, contigs, ReadOptions(min_map_qual=10)).first()
    assert (x.reads_produced, x.reads_aligned, x.duplicate_reads, x.proper_paired, x.chimeric_reads, x.supplementary_reads) == (8, 4, 1, 1, 2, 1)
    assert (x.reads_paired, x.paired_with_mapped_mate, x.mapped_bases, x.read_length) == (4, 3, 40, 10)
    assert {r.read_id: r.stage for r in reads.staged(df, ReadOptions(min_map_qual=10)).collect()} == {1: "used", 2: "unmapped", 3: "low_mapq", 4: "qc_fail", 5: "secondary", 6: "duplicate", 7: "supplementary", 8: "used", 9: "used"}
    many = spark.range(400).selectExpr("concat('r', id) as qname")
    half = {r.qname for r in reads.downsample(many, 0.5).collect()}
    assert 150 < len(half) < 250 and half == {r.qname for r in reads.downsample(many.repartition(3), 0.5).collect()}


def test_blocks(spark):
    df, contigs = tables(spark, [read(1, 5, "2S3M1I2=1D1X5N1M4H3P", n=10), read(2, 195, "10M"), read(3, 45, "3M2I9M", contig="d")])
    rows = got(reads.blocks(df, contigs), "read_id", "kind", "start", "end", "q_start")
    assert rows == [(1, "I", 8, 8, 5), (1, "M", 5, 8, 2), (1, "M", 8, 10, 6), (1, "M", 11, 12, 8), (1, "M", 17, 18, 9), (2, "M", 195, 200, 0), (3, "I", 48, 48, 3), (3, "M", 45, 48, 0), (3, "M", 48, 50, 5)]


def test_base_quality(spark):
    quals = [30, 10, 10, 30, 45, 30, 10, 30, 30, 10]
    df, contigs = tables(spark, [read(1, 20, quals=quals), read(2, 60, "4M2I4M", quals=quals)])
    options = ReadOptions(min_base_qual=20)
    assert got(reads.depth_blocks(df, contigs, options), "read_id", "start", "end") == [(1, 20, 21), (1, 23, 26), (1, 27, 29), (2, 60, 61), (2, 63, 64), (2, 65, 67)]
    assert tuple(reads.quality_counts(df, contigs, options).first()) == (12, 12, 2, 18)


def test_mate_overlap(spark):
    rows = [
        read(1, 10, isize=15, mate=15, mc="10M"),  # ends in its mate
        read(2, 10, isize=15, mate=30, mc="10M"),  # apart
        read(3, 10, isize=15, mate=5, mc="30M"),  # inside its mate
        read(4, 10, isize=15, mate=16),  # without the mate's CIGAR
        read(5, 10, isize=15, mate=4),  # starts after its mate
        read(6, 10, isize=-15, mate=15, mc="10M"),  # the other one of a pair
        read(7, 10, isize=15, mate=13, mc="3M"),  # the mate lies inside
    ]
    df, contigs = tables(spark, rows)
    marked = {r.read_id: (r.overlap_bases, r.inside_mate) for r in reads.mate_overlap(df).collect()}
    assert marked == {1: (5, False), 2: (0, False), 3: (10, True), 4: (4, False), 5: (10, False), 6: (0, False), 7: (3, False)}
    kept = got(reads.depth_blocks(df, contigs, ReadOptions(exclude_overlap=True)), "read_id", "start", "end", "q_start")
    assert kept == [(1, 10, 15, 0), (2, 10, 20, 0), (4, 10, 16, 0), (6, 10, 20, 0), (7, 10, 13, 0), (7, 16, 20, 6)]


def test_buffers_and_classes(spark):
    df, contigs = tables(spark, [read(1, 28), read(2, 12), read(3, 150), read(4, 40), read(5, 41, "1M", n=1)])
    targets = spark.createDataFrame([(0, "c", 30, 40, 1), (0, "c", 3, 5, 2)], "set_id int, contig string, start int, end int, interval_id int")
    flank = intervals.buffers(targets, contigs, 10)
    assert got(flank, "contig", "start", "end") == [("c", 0, 3), ("c", 6, 16), ("c", 20, 30), ("c", 41, 51)]
    assert tuple(reads.target_classes(df, contigs, targets, flank).first()) == (0, 1, 3, 1)


def test_summary_and_breadth(spark):
    counts = spark.createDataFrame([(0, 60, 100, 40), (1, 10, 100, 40), (5, 50, 100, 40), (2000, 20, 100, 40)], "depth long, n long, bases long, n_total long")
    x = stats.summary(counts, "bases", excluded="n_total").first()
    assert (x.sum_depth, x.median_depth, x.max_depth, x.bases_at_max) == (40260, 5, 2000, 20)
    rows = {r.threshold: (r.n_bases, r.pct) for r in stats.breadth(counts, "bases", excluded="n_total").collect()}
    assert rows[0] == (20, 20.0) and rows[1] == (80, 80.0) and rows[6] == (20, 20.0) and rows[1000] == (20, 20.0)
    h = stats.histogram(counts).collect()
    assert len(h) == 1001 and sum(r.n_bases for r in h) == 140 and [r.n_bases for r in h if r.depth == 1000] == [20]


def test_gene_percentages(spark):
    cds = spark.createDataFrame([("c", 0, 10, "G", "T1", 1, "gene"), ("c", 20, 30, "G", "T1", 2, "gene"), ("c", 20, 30, "G", "T1", 2, "gene"), ("c", 0, 20, "G", "T2-1", -1, "gene"), ("c", 5, 9, "H", "T3", -2, "gene")], SPANS + ", gene string, transcript string, exon_id int, type string")
    low = spans(spark, [("c", 5, 8), ("c", 7, 12)])
    rows = genes.cds_coverage(cds, low)
    assert got(rows, "transcript", "exon_id", "low_bases", "pct", "low_regions") == [("T1", 1, 5, 50.0, "5-10"), ("T1", 2, 0, 100.0, None), ("T2-1", -1, 7, 65.0, "5-12"), ("T3", -2, 4, 0.0, "NOT_Designed")]
    tx = genes.transcript_coverage(rows)
    assert got(tx, "gene", "transcript", "length", "n_cds", "pct") == [("G", "T1", 20, 2, 75.0), ("G", "T2-1", 20, 1, 65.0), ("H", "T3", 4, 1, 0.0)]
    assert got(genes.gene_coverage(tx)) == [("G", 2, 70.0, "T1(75.00);T2-1(65.00)"), ("H", 1, 0.0, "T3(0.00)")]
    only = genes.preferred_only(tx, spark.createDataFrame([("T2",)], "transcript string"))
    assert got(only, "gene", "transcript") == [("G", "T2-1"), ("H", "T3")]
    assert got(genes.gene_transcripts(cds)) == [("G", "T1"), ("G", "T2-1"), ("H", "T3")]


def test_batch(spark):
    rows = [(s, "c", 0, 10) for s in range(3)] + [(s, "c", 8, 20) for s in range(2)] + [(0, "c", 50, 60), (3, "c", 70, 80)]
    df = spark.createDataFrame(rows, "sample_id int, contig string, start int, end int")
    assert tuple(batch.recurrence_threshold(df, 50).first()) == (4, 2)
    low = batch.recurrent(df, 50)
    assert got(low) == [("c", 0, 20)]
    cds = spark.createDataFrame([("c", 15, 25, "G", "T", 1), ("c", 30, 40, "G", "T", 2), ("c", 0, 5, "H", ".", 1)], SPANS + ", gene string, transcript string, exon_id int")
    exons = batch.exon_coverage(low, cds)
    assert got(exons, "exon_id", "low_bases", "pct") == [(1, 5, 50.0), (2, 0, 100.0)]
    assert got(batch.gene_coverage(batch.transcript_coverage(exons))) == [("G", 1, 75.0)]


def test_annotation(spark):
    exons = annotate.annotated_exons(spark.createDataFrame([("c", 10, 20, "A", "NM_1", 1, "gene"), ("c", 15, 30, "B", "CCDS7", 2, "gene"), ("c", 18, 19, "B", "x", 3, "SNP")], SPANS + ", gene string, transcript string, exon_id int, type string"))
    introns = spark.createDataFrame([("c", 40, 60, "A", "ENST1"), ("c", 45, 70, "C", "NR_2")], SPANS + ", gene string, name string")
    names = spark.createDataFrame([("A", ["a1", "B"], ["old"])], "gene string, synonyms array<string>, prev array<string>")
    regions = spans(spark, [("c", 12, 19), ("c", 50, 55), ("c", 90, 99)])
    rows = {r.start: r for r in annotate.annotate(regions, exons, introns, synonyms=names).collect()}
    assert (rows[12].kind, rows[12].genes, rows[12].synonyms, rows[12].prev, rows[12].refseq, rows[12].ccds, rows[12].other) == ("exon", "A;B", "a1", "old", "NM_1_cds_1", "CCDS7_cds_2", "x_cds_3")
    assert (rows[50].kind, rows[50].genes, rows[50].vega, rows[50].refseq) == ("intron", "A", "ENST1", None)
    assert (rows[90].kind, rows[90].genes) == ("intergenic", None)


def test_an_intron_without_a_gene_keeps_its_dot(spark):
    exons = annotate.annotated_exons(spark.createDataFrame([("c", 0, 10, ".", "NM_1", 1, "gene")], SPANS + ", gene string, transcript string, exon_id int, type string"))
    introns = spark.createDataFrame([("c", 40, 60, ".", "NR_2"), ("c", 45, 70, "A", "NM_3")], SPANS + ", gene string, name string")
    names = spark.createDataFrame([(".", ["a1"], ["old"])], "gene string, synonyms array<string>, prev array<string>")
    regions = spans(spark, [("c", 5, 8), ("c", 50, 55), ("c", 65, 66)])
    for more in ({}, {"synonyms": names}):
        assert got(annotate.annotate(regions, exons, introns, **more), "start", "kind", "genes", "refseq") == [(5, "exon", None, "NM_1_cds_1"), (50, "intron", ".", "NR_2"), (65, "intron", "A", "NM_3")]
    assert got(annotate.annotate(regions, exons, introns, synonyms=names), "synonyms") == [(None,)] * 3


def test_annotation_tables(spark):
    models = spark.createDataFrame(
        [("NM_1", "chr1", "-", 0, 100, 10, 90, 3, [0, 40, 80], [20, 60, 100], None), ("NM_1", "chr2_alt", "+", 0, 50, 50, 50, 1, [0], [50], "X"), ("XM_9", "chr1", "+", 0, 50, 5, 40, 1, [0], [50], "Y")],
        "name string, contig string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exon_count int, exon_starts array<int>, exon_ends array<int>, symbol string",
    )
    registry = spark.createDataFrame([(5, "S5", "old", "NM_1,NM_2"), (7, "S7", None, "NM_1")], "hgnc_id long, symbol string, prev string, refseq string")
    assert got(annotation_etl.exon_rows(models).filter("contig = 'chr1' and name = 'NM_1'"), "exon_id", "start", "cds_length") == [(0, 80, 40), (1, 40, 40), (2, 0, 40)]
    assert got(annotation_etl.exon_rows(models).filter("contig = 'chr2_alt'"), "cds_length") == [(50,)]
    assert got(annotation_etl.cds_coordinates(models, registry), "contig", "cds_start", "cds_end", "gene", "exon_id") == [("1", 10, 20, "S5", 2), ("1", 40, 60, "S5", 1), ("1", 80, 90, "S5", 0)]
    assert got(annotation_etl.introns(models), "start", "end") == [(20, 40), (60, 80)]
    assert got(annotation_etl.unique_names(models), "name", "contig") == [("NM_1", "chr1"), ("NM_1-1", "chr2_alt"), ("XM_9", "chr1")]
    assert got(annotation_etl.named(models.select("name"), registry).filter("name = 'NM_1'").distinct(), "hgnc_symbol", "hgnc_prev") == [("S5", "old")]
