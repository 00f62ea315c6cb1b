"""Operators that work by bins or in one sweep, against plain Python, with bins so small that edges matter."""

import random

import pytest

from depthwise.operators import depth, genes, intervals, runs, uniformity
from depthwise.storage import stored
from depthwise.sources import validate

SPAN = "contig string, start int, end int"


def disjoint(r, n, most=12, contigs="cd"):
    out = []
    for c in contigs:
        at = 0
        for _ in range(n):
            at += r.randint(1, 9)
            out.append((c, at, at + r.randint(1, most)))
            at = out[-1][2]
    return out


@pytest.mark.parametrize("width", [4, 16, 1000])
def test_unmerged(spark, width):
    r = random.Random(width)
    rows = [(k, c, s, s + r.randint(1, 6)) for k, (c, s) in enumerate((r.choice("cd"), r.randint(0, 200)) for _ in range(60))]
    got = {x.id for x in validate.unmerged(spark.createDataFrame(rows, f"id int, {SPAN}"), (), width).collect()}
    sure = {k for k, c, s, e in rows if any(c == b and e2 >= s and (s2, e2) < (s, e) for _, b, s2, e2 in rows)}
    twins = {k for k, c, s, e in rows if any(k != j and (c, s, e) == (b, s2, e2) for j, b, s2, e2 in rows)}
    assert sure <= got <= sure | twins and all(len({x for x in got if rows[x][1:] == rows[k][1:]}) + 1 >= sum(v[1:] == rows[k][1:] for v in rows) for k in twins)


@pytest.mark.parametrize("width", [8, 64])
def test_plot_points(spark, width):
    r = random.Random(3)
    blocks = [(c, s, e, r.randint(0, 9)) for c, s, e in disjoint(r, 30)]
    got = sorted((x.contig, x.pos, x.value) for x in uniformity.plot_points(spark.createDataFrame(blocks, f"{SPAN}, mean_depth long"), highest=7, shown=6, step=3, width=width).collect())
    want, before = [], {}
    for c, s, e, d in blocks:
        want += [(c, p, 0) for p in range(before.get(c, s), s, 3)] + [(c, s, 6 if d > 7 else d)]
        before[c] = e
    assert got == sorted(want)


@pytest.mark.parametrize("width", [16, 500])
def test_off_target(spark, width):
    r = random.Random(5)
    depth, at = [], 0
    for _ in range(60):
        at2 = at + r.randint(1, 10)
        depth.append(("c", at // width, at, at2, r.choice([0, 0, 5, 30, 40])))
        at = at2
    cut = [(c, b, max(s, b * width), min(e, (b + 1) * width), d) for c, _, s, e, d in depth for b in range(s // width, (e - 1) // width + 1)]
    targets = [(k, c, s, e) for k in (0, 1, 4) for c, s, e in disjoint(r, 6, contigs="c")]
    rle = spark.createDataFrame(cut, "contig string, bin int, start int, end int, depth long")
    found = runs.off_target(rle, spark.createDataFrame(targets, f"set_id int, {SPAN}"), 20, 2, width)
    at_base = {p: d for _, _, s, e, d in depth for p in range(s, e)}
    want = []
    for k in (0, 1, 4):
        free = [p for p, d in sorted(at_base.items()) if d > 0 and not any(s - 2 <= p <= e + 2 for j, _, s, e in targets if j <= k)]
        run = []
        for p in [*free, None]:
            if run and p != run[-1] + 1:
                if max(at_base[x] for x in run) > 20:
                    want.append((k, "c", next(x for x in run if at_base[x] > 20), run[-1] + 1, max(at_base[x] for x in run)))
                run = []
            run.append(p)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    assert runs.off_target(rle, spark.createDataFrame([], f"set_id int, {SPAN}"), 20, 2, width).collect() == []


@pytest.mark.parametrize("width,join", [(8, 32), (32, 8), (8, 8)])
def test_low_runs_in_targets_cross_all_bins(spark, width, join):
    """The bins of the depth and those of the join with the targets differ; runs are cut at neither."""
    r = random.Random(width + join)
    d = [r.choice([5, 5, 5, 30]) for _ in range(300)]
    rle = spark.createDataFrame([("c", p // width, p, p + 1, d[p]) for p in range(300)], "contig string, bin int, start int, end int, depth long")
    targets = [(k % 2, "c", k, s, s + r.randint(1, 70)) for k, s in enumerate(r.randint(0, 230) for _ in range(12))]
    on = depth.target_depth(rle, spark.createDataFrame(targets, "set_id int, contig string, interval_id int, start int, end int"), (), join)
    want = []
    for k, _, i, s, e in targets:
        low = [p for p in range(s, e) if d[p] < 20]
        starts, ends = [p for p in low if p - 1 not in low], [p + 1 for p in low if p + 1 not in low]
        want += [(k, i, a, b, 5) for a, b in zip(starts, ends)]
    assert sorted((x.set_id, x.interval_id, x.start, x.end, x.mean_depth) for x in runs.low_runs(on, 20, ["set_id", "interval_id"], width).collect()) == sorted(want)
    assert {x.bin * width <= x.start < x.end <= (x.bin + 1) * width for x in on.collect()} == {True}


def test_a_bin_of_the_left_side_stays(spark):
    a, b = spark.createDataFrame([("c", 3, 10, 20)], "contig string, bin int, start int, end int"), spark.createDataFrame([("c", 15, 40)], SPAN)
    assert [tuple(x) for x in intervals.overlap_join(a, b, (), 4).collect()] == [("c", 3, 10, 20, 15, 40, 15, 20)]


def test_cds_in_several_targets(spark):
    cds = spark.createDataFrame([("c", 0, 100, "g", "t", 1), ("c", 0, 100, "g", "t", 1), ("c", 40, 50, "g", "t", -1), ("c", 60, 70, "g", "t", -5), ("d", 0, 9, "g", "t", 2)], f"{SPAN}, gene string, transcript string, exon_id int")
    targets = spark.createDataFrame([("c", 10, 20), ("c", 50, 60), ("c", 55, 65), ("c", 65, 66)], SPAN)
    cut = genes.cds_in_targets(cds, targets)
    assert sorted((x.start, x.end, x.targeted, [tuple(p) for p in x.pieces]) for x in cut.collect()) == [(0, 100, 26, [(10, 20), (50, 66)]), (60, 70, 6, [(60, 66)])]
    low = spark.createDataFrame([("c", 12, 14), ("c", 50, 56), ("c", 55, 60)], SPAN)
    got = {x.start: (x.length, x.low_bases, x.pct, x.low_regions, x.label, x.pieces) for x in genes.cds_coverage(cut, low).withColumn("label", genes.exon_label(genes.F.col("exon_id"))).collect()}
    assert got == {0: (26, 12, 14 * 100 / 26, "12-14;50-60", "cds_1", "10-20;50-66"), 60: (6, 0, 0.0, "NOT_Designed", "cds_-5", "60-66")}


def test_cds_of_a_cohort_has_all_samples(spark):
    cds = spark.createDataFrame([("c", 0, 10, "g", "t", 1), ("c", 20, 30, "g", "t", 2)], f"{SPAN}, gene string, transcript string, exon_id int")
    low = spark.createDataFrame([("a", "c", 0, 5), ("a", "c", 22, 24), ("b", "c", 8, 12)], f"who string, {SPAN}")
    samples = spark.createDataFrame([("a",), ("b",), ("z",)], "who string")
    got = {(x.who, x.start, x.low_bases) for x in genes.cds_coverage(cds, low, ["who"], samples=samples).collect()}
    assert got == {("a", 0, 5), ("a", 20, 2), ("b", 0, 2), ("b", 20, 0), ("z", 0, 0), ("z", 20, 0)}


def test_stored(spark):
    df = spark.range(5).selectExpr("id", "cast(null as string) as x")
    back = stored(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 5


def greedy(rows, factor):
    """Segments (start, end, depth) -> blocks of the split from the left, a block for each run at least."""
    out = []
    for s, e, d in rows:
        if out and out[-1][1] == s and max(out[-1][3], d) <= min(out[-1][2], d) * factor:
            b = out[-1]
            out[-1] = (b[0], e, min(b[2], d), max(b[3], d), b[4] + d * (e - s))
        else:
            out.append((s, e, d, d, d * (e - s)))
    return {(s, e, int(t / (e - s) + 0.5)) for s, e, _, _, t in out}


@pytest.mark.parametrize("width,factor", [(4, 2), (7, 1.3), (64, 3), (1000, 2), (5, 1)])
def test_greedy_split_over_many_bins(spark, width, factor):
    r = random.Random(width)
    rows, at = [], 0
    for k in range(320):  # one run over some fifty bins and more of the small widths, then gaps
        e = at + r.randint(1, 5)
        rows.append((at, e, r.choice([5, 11, 12, 14, 20, 23, 30, 41, 60]) if k < 200 or r.random() < 0.9 else 3))
        at = e
    cut = [(c, s // width + j, max(s, (s // width + j) * width), min(e, (s // width + j + 1) * width), d) for c in "cd" for s, e, d in rows for j in range((e - 1) // width - s // width + 1)]
    df = spark.createDataFrame(cut, "contig string, bin int, start int, end int, depth int").repartition(7)
    got = uniformity.gvcf_blocks(df, 1, 10, factor, (), width).filter("class = 2").collect()
    want = greedy([x for x in rows if x[2] > 10], factor)
    assert {x.contig for x in got} == {"c", "d"}
    for c in "cd":
        assert sorted((x.start, x.end, x.mean_depth) for x in got if x.contig == c) == sorted(want)
    assert width > 60 or max((e - 1) // width - s // width for s, e, _ in want) >= 1


def test_transfer_of_a_bin_equals_the_walk():
    r = random.Random(2)
    for _ in range(300):
        depth, state, factor = [r.randint(10, 60) for _ in range(r.randint(1, 30))], tuple(sorted((r.randint(10, 60), r.randint(10, 60)))), r.choice([1, 1.5, 2, 4])
        if state[1] > state[0] * factor:
            continue
        low, high = state
        for d in depth:
            low, high = (min(low, d), max(high, d)) if max(high, d) <= min(low, d) * factor else (d, d)
        assert uniformity.through_bin(state, *uniformity.bin_transfer(depth, factor), factor) == (low, high)
