"""Readers whose results depend on files, splits and the order of lines."""

import random
from contextlib import contextmanager

import pytest

from depthwise.operators import annotation_etl, intervals, runs
from depthwise.sources import readers, sinks, validate


@contextmanager
def splits(spark, size):
    """Files are read in splits of that many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def bytes_read(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): (stages.apply(k).inputBytes(), stages.apply(k).numTasks()) for k in range(stages.size())}


def test_a_header_is_read_without_the_reads_behind_it(spark, tmp_path):
    for k in (0, 1):
        reads = "".join(f"r{j}\t0\tc1\t{j + 1}\t60\t50M\t*\t0\t0\t{'A' * 50}\t{'I' * 50}\n" for j in range(60_000))
        (tmp_path / f"{k}.sam").write_text(f"@HD\tVN:1.6\n@SQ\tSN:c{k}\tLN:{100 + k}\n@SQ\tLN:70\tSN:c:9\tAS:x\n@CO\ttext\n{reads}@SQ\tSN:late\tLN:1\n")
    before = bytes_read(spark)
    with splits(spark, 100_000):
        got = readers.contigs_of_header(spark, str(tmp_path)).collect()
        after = {k: v for k, v in bytes_read(spark).items() if k not in before and v[0]}
    assert [(r.contig, r.length, r.ordinal) for r in got] == [("c0", 100, 0), ("c:9", 70, 1), ("c1", 101, 2)]
    assert len(after) == 2 and all(tasks == 1 and read <= 300_000 for read, tasks in after.values())


def test_a_header_longer_than_a_split(spark, tmp_path):
    (tmp_path / "x y%.sam").write_text("".join(f"@SQ\tSN:contig{k}\tLN:{k}\n" for k in range(1500)) + "r\t0\tc\t1\t60\t1M\t*\t0\t0\tA\tI\n" * 900)
    with splits(spark, 5_000):
        got = readers.contigs_of_header(spark, str(tmp_path / "x y%.sam")).collect()
    assert [(r.contig, r.length, r.ordinal) for r in got] == [(f"contig{k}", k, k) for k in range(1500)]


def test_an_empty_header(spark, tmp_path):
    (tmp_path / "x.sam").write_text("r\t0\tc\t1\t60\t1M\t*\t0\t0\tA\tI\n")
    assert readers.contigs_of_header(spark, str(tmp_path / "x.sam")).collect() == []


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_interval_ids_do_not_depend_on_splits(spark, tmp_path, size):
    for name in ("b", "a"):
        (tmp_path / f"{name}.bed").write_text("# c\n\n" + "".join(f"c\t{k}\t{k + 2 + (name == 'b')}\n" for k in range(300)))
    with splits(spark, size):
        got = sorted((r.interval_id, r.start, r.end) for r in readers.intervals(spark, [str(tmp_path / "b.bed"), str(tmp_path / "a.bed")]).collect())
    assert got == [(k, k % 300, k % 300 + 2 + k // 300) for k in range(600)]


def problems(lines):
    """As the description has it: one file, line by line."""
    out, seen, last = [], set(), None
    for c, s, e, a in lines:
        if last and last[0] == c:
            if last[1] >= s:
                out.append((c, s, e, a, "start not above the last"))
        elif c in seen:
            out.append((c, s, e, a, "contig comes again"))
        seen.add(c)
        last = (c, s)
        if s >= e:
            out.append((c, s, e, a, "empty interval"))
        if len([x for x in a.split("|") if x]) < 3:
            out.append((c, s, e, a, "too few fields"))
    return out


@pytest.mark.parametrize("size", [60, 500, 1 << 20])
def test_annotation_problems_in_the_order_of_the_file(spark, tmp_path, size):
    r, files, want = random.Random(size), {}, []
    for name in ("one", "two"):
        lines, start = [], 0
        for k in range(250):
            start = max(0, start + r.choice([3, 3, 3, 5, 9, 0, -4]))
            lines.append((f"chr{1 + k // 60 if r.random() < 0.97 else r.randint(1, 4)}", start, start + r.choice([1, 5, 9, 9, 0]), r.choice(["G|T|cds_1|gene", "G|T|cds_2", "G|T"])))
        files[name] = lines
        (tmp_path / f"{name}.bed").write_text("#head\n" + "".join("\t".join(map(str, x)) + ("\n\n# note\n" if k % 9 == 0 else "\n") for k, x in enumerate(lines)))
        want += [(name, *x) for x in problems(lines)]
    with splits(spark, size):
        got = [(r.file.rsplit("/", 1)[1][:-4], r.contig, r.start, r.end, r.annotation, r.problem) for r in validate.annotation_problems(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {"start not above the last", "contig comes again"} <= {x[-1] for x in want}


def test_a_sorted_file_has_no_problem_and_an_equal_start_is_one(spark, tmp_path):
    (tmp_path / "a").write_text("c\t1\t9\tg|t|cds_1\nc\t2\t9\tg|t|cds_2\nd\t0\t4\tg|t|1|gene\n")
    assert validate.annotation_problems(spark, str(tmp_path / "a")).collect() == []
    (tmp_path / "b").write_text("c\t2\t9\tg|t|cds_1\nc\t2\t9\tg|t|cds_2\nc\t1\t4\tg|t|1|gene\n")
    assert [r.problem for r in validate.annotation_problems(spark, str(tmp_path / "b")).collect()] == ["start not above the last"] * 2


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_sets_of_a_manifest_by_path(spark, tmp_path, size):
    beds = {"t.bed": 3, "sub/t.bed": 5, "a%b.bed": 4, "a b+c.bed": 2, "folder/x.bed": 6}
    for k, (name, n) in enumerate(beds.items()):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("".join(f"c\t{10 * j}\t{10 * j + k + 1}\n" for j in range(n)))
    (tmp_path / "n%20.anno").write_text("c\t0\t5\tG|T|cds_1|gene\nc\t7\t7\tG|T|9\n")
    paths = [*list(beds)[:4], "folder"]
    (tmp_path / "manifest").write_text("\n".join(f"{tmp_path}/{p}" + ("" if k == 1 or k == 4 else f"\t{tmp_path}/n%20.anno") for k, p in enumerate(paths)) + "\r\n\n#end\n")
    with splits(spark, size):
        targets, annotated = readers.target_sets(spark, str(tmp_path / "manifest"))
        rows, notes = targets.collect(), annotated.collect()
    assert sorted((r.set_id, r.start, r.end) for r in rows) == sorted((k, 10 * j, 10 * j + k + 1) for k, n in enumerate(beds.values()) for j in range(n))
    assert len({(r.set_id, r.interval_id) for r in rows}) == len(rows)
    assert sorted((r.set_id, r.start, r.end, r.exon_id) for r in notes) == sorted((k, *x) for k in (0, 2, 3) for x in ((0, 5, 1), (6, 7, 9)))


def test_bad_manifests(spark, tmp_path):
    for text in ("a.bed\nb.bed\na.bed\n", "\tonly.anno\n"):
        (tmp_path / "m").write_text(text)
        with pytest.raises(ValueError):
            readers.target_sets(spark, str(tmp_path / "m"))


def test_a_region_report_of_many_files_is_in_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, s, s + 7, 7, k, None if k % 3 else f"G{k}") for k, (c, s) in enumerate((c, s) for c in ("x", "a", "m") for s in r.sample(range(10_000), 150))]
    df = spark.createDataFrame(rows, "contig string, start int, end int, length int, mean_depth int, genes string").repartition(5)
    contigs = spark.createDataFrame([("x", 0), ("m", 1), ("a", 2)], "contig string, ordinal int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_regions(df, str(tmp_path / "r"), contigs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "r").glob("part-*"))) > 2
    with splits(spark, 700):
        back = sorted(readers.region_reports(spark, str(tmp_path / "r")).collect(), key=lambda x: x.line)
    assert [x.line for x in back] == list(range(1, 451))
    want = sorted(rows, key=lambda x: ("xma".index(x[0]), x[1]))
    assert [(x.contig, x.start, x.end, x.length, x.mean_depth, x.genes) for x in back] == want and back[0].other is None


def test_annotation_tables_are_written_by_ranges_and_pruned(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('c', id % 2) as contig", "cast(id as int) as start", "cast(id + 5 as int) as end")
    sinks.write_annotation(rows, str(tmp_path / "t"), 6)
    assert all(len(list((tmp_path / "t" / f"contig=c{k}").glob("*.parquet"))) > 1 for k in (0, 1))
    wanted = spark.createDataFrame([("c1", 5), ("c0", 1)], "contig string, n int").filter("n > 3")
    got = readers.annotation_table(spark, str(tmp_path / "t")).join(wanted.hint("broadcast"), "contig")
    assert got.count() == 1500 and "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert readers.annotation_table(spark, str(tmp_path / "t"), "c0").count() == 1500


def test_exon_table_columns(spark):
    models = spark.createDataFrame(
        [("NM_1-2", "c", "+", 0, 20, 0, 20, 1, [0], [20], "S9"), ("ENST7.3", "c", "+", 10, 30, 10, 30, 1, [10], [30], None), ("hsa-mir-21", "c", "-", 10, 20, 10, 20, 1, [10], [20], "."), ("odd", "c", "+", 25, 30, 25, 30, 1, [25], [30], "B")],
        "name string, contig string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exon_count int, exon_starts array<int>, exon_ends array<int>, symbol string",
    )
    registry = spark.createDataFrame([(1, "S1", "P1", "NM_1,NM_2", "ENST7", "hsa-mir-21"), (2, "S2", "P1", "NM_1", None, None), (3, "S0", None, None, "ENST7", "hsa-mir")], "hgnc_id int, symbol string, prev string, refseq string, ensembl string, mirbase string")
    got = {(r.start, r.end): tuple(r)[3:] for r in annotation_etl.exon_table(models, registry).collect()}
    assert got == {
        (0, 10): ("S1", "S2;S9", "P1", "NM_1-2|exon_0|gene", None, None, None, None),
        (10, 20): ("S0", "S1;S2;S9", "P1", "NM_1-2|exon_0|gene", None, "ENST7.3|exon_0|gene", "hsa-mir-21|exon_0|gene", None),
        (20, 25): ("S0", "S1", "P1", None, None, "ENST7.3|exon_0|gene", None, None),
        (25, 30): ("B", "S0;S1", "P1", None, None, "ENST7.3|exon_0|gene", None, "odd|exon_0|gene"),
    }


@pytest.mark.parametrize("n,width", [(5, 8), (130, 16), (64, 1000), (0, 8)])
def test_sets_of_many_samples(spark, n, width):
    r = random.Random(n)
    rows = [(f"s{k:03d}", c, s, s + r.randint(1, 30)) for k in range(n) for c in "cd" for s in (r.randrange(60) for _ in range(3))]
    df = spark.createDataFrame(rows, "sample_id string, contig string, start int, end int").repartition(4)
    got = sorted((x.contig, x.start, x.end, x.n_samples, tuple(x.samples)) for x in intervals.multi_sets(df, width=width).collect())
    want = []
    for c in "cd":
        for p in range(100):
            names = tuple(sorted({s for s, k, a, b in rows if k == c and a <= p < b}))
            if names and want and want[-1][0] == c and want[-1][2] == p and want[-1][4] == names:
                want[-1] = (c, want[-1][1], p + 1, len(names), names)
            elif names:
                want.append((c, p, p + 1, len(names), names))
    assert got == want
    count = sorted((x.contig, x.start, x.end, x.n_samples) for x in intervals.multi_depth(df, width=width).collect())
    assert sum((e - s) * k for _, s, e, k in count) == sum((e - s) * k for _, s, e, k, _ in want)


def test_off_target_of_many_sets(spark):
    """A hundred sets, each with a target of its own: a base is free for the sets before the lowest that covers it."""
    rle = spark.createDataFrame([("c", k, k * 100, (k + 1) * 100, 30) for k in range(20)], "contig string, bin int, start int, end int, depth int")
    targets = spark.createDataFrame([(k, "c", 17 * k + 5, 17 * k + 10) for k in range(100)], "set_id int, contig string, start int, end int")
    got = {}
    for x in runs.off_target(rle, targets, 20, 2, 100).collect():
        got.setdefault(x.set_id, []).append((x.start, x.end))
    for k in range(100):
        free = [p for p in range(2000) if not any(17 * j + 3 <= p < 17 * j + 13 for j in range(k + 1))]
        edges = [p for p in free if p - 1 not in set(free)]
        assert sorted(s for s, _ in got[k]) == edges
