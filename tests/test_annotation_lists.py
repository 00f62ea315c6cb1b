"""Exon and intron tables where an id has many symbols and many models, against plain Python."""

import hashlib
import random
import time

import pytest

from depthwise.operators import annotation_etl
from depthwise.operators.annotation_etl import PREFIXES
from depthwise.sources import readers, sinks

MODELS = "name string, contig string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exon_count int, exon_starts array<int>, exon_ends array<int>, symbol string"
REGISTRY = "hgnc_id int, symbol string, prev string, refseq string, ensembl string, ccds string"


def tables(seed):
    r = random.Random(seed)
    models = []
    for _ in range(40):
        at, exons = r.randint(0, 150), []
        for _ in range(r.randint(1, 4)):
            exons.append((at, at + r.randint(1, 25)))
            at = exons[-1][1] + r.randint(1, 25)
        name = r.choice(["NM_1", "NM_2-3", "NM_2", "XR_5", "ENST1.4", "ENST2", "CCDS1", "hsa-1", "odd"])
        models.append((name, r.choice("cd"), r.choice("+-"), exons[0][0], exons[-1][1], 0, 0, len(exons), [s for s, _ in exons], [e for _, e in exons], r.choice([None, ".", "S1", "S4", "T1", "T2"])))
    ids = lambda *all_: ", ".join(r.sample(all_, r.randint(0, 2))) or None
    registry = [(k, r.choice(["S1", "S2", "S3", "S4", "."]), r.choice([None, "P1", "P2", "S1", "T1"]), ids("NM_1", "NM_2", "XR_5"), ids("ENST1", "ENST2"), ids("CCDS1", "CCDS2")) for k in range(9)]
    return models, registry


def plain(models, registry, introns):
    rows, exons = [], []
    for name, contig, strand, _, _, _, _, n, starts, ends, symbol in models:
        exons += [(contig, s, e) for s, e in zip(starts, ends)]
        if introns:
            rows += [(contig, ends[k], starts[k + 1], name, symbol, f"{name}|intron_{k + 1}|gene") for k in range(n - 1)]
        else:
            rows += [(contig, s, e, name, symbol, f"{name}|exon_{n - k - 1 if strand == '-' else k}|gene") for k, (s, e) in enumerate(zip(starts, ends))]
    lists = ("hgnc_id", "symbol", "prev", "refseq", "ensembl", "ccds")
    out = {}
    for c in "cd":
        cuts = sorted({x for k, s, e, *_ in [*rows, *(exons if introns else [])] if k == c for x in (s, e)})
        for a, b in zip(cuts, cuts[1:]):
            over = [x for x in rows if x[0] == c and x[1] <= a and b <= x[2]]
            if not over or introns and any(k == c and s < b and a < e for k, s, e in exons):
                continue
            genes, prevs, labels = {x[4] for x in over}, set(), {}
            for _, _, _, name, _, label in over:
                _, where, column = next((p for p in PREFIXES if name.startswith(p[0])), (None, None, "other"))
                labels.setdefault(column, set()).add(label)
                plain_name = name.split(".")[0].split("-")[0] if where == "refseq" else name.split(".")[0]
                for entry in registry:
                    if where in lists and plain_name in [x.strip() for x in (entry[lists.index(where)] or "").split(",")]:
                        genes.add(entry[1])
                        prevs.add(entry[2])
            genes, prevs = sorted(genes - {None, "."}), prevs - {None}
            prevs = sorted(prevs - set(genes) if introns else prevs)
            text = lambda x: ";".join(sorted(x)) or None
            out[c, a, b] = (genes[0] if genes else None, text(genes[1:]), text(prevs), *(text(labels.get(k, ())) for k in annotation_etl.SOURCES))
    return out


@pytest.mark.parametrize("most", [2, 1000])
def test_tables_against_plain_python(spark, most, monkeypatch):
    monkeypatch.setattr(annotation_etl, "SEGMENTS_OF_A_COPY", most)
    for seed in (1, 2):
        models, registry = tables(seed)
        m, r = spark.createDataFrame(models, MODELS), spark.createDataFrame(registry, REGISTRY)
        for introns, table in ((False, annotation_etl.exon_table), (True, annotation_etl.intron_table)):
            got = {tuple(x)[:3]: tuple(x)[3:] for x in table(m, r).collect()}
            assert got == plain(models, registry, introns)


def shuffled(spark):
    time.sleep(1)  # the figures are behind the tasks
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("table", [annotation_etl.exon_table, annotation_etl.intron_table])
def test_lists_are_not_shuffled_with_every_row(spark, table):
    """1,000 symbols of one id and 1,000 models of it: 36 MB of text, of which shuffles see no copy for each model."""
    models = [("NM_1", "c", "+", k * 100, k * 100 + 60, 0, 0, 2, [k * 100, k * 100 + 40], [k * 100 + 20, k * 100 + 60], "S") for k in range(1000)]
    registry = [(k, hashlib.md5(str(k).encode()).hexdigest(), None, "NM_1", None, None) for k in range(1000)]
    before = shuffled(spark)
    rows = table(spark.createDataFrame(models, MODELS), spark.createDataFrame(registry, REGISTRY)).selectExpr("length(synonyms) as n").groupBy("n").count().collect()
    assert [(x.n, x["count"]) for x in rows] == [(999 * 33 + 1, 2000 if table is annotation_etl.exon_table else 1000)]
    assert shuffled(spark) - before < 3_000_000


def test_a_table_in_parts_is_whole_and_small(spark, tmp_path):
    """1,000 symbols of one id on 2,000 segments: 66 MB of text, whose lists are written once, and read for one contig's folder."""
    models = [("NM_1", "cd"[k % 2], "+", k * 100, k * 100 + 60, 0, 0, 2, [k * 100, k * 100 + 40], [k * 100 + 20, k * 100 + 60], None) for k in range(1000)]
    registry = [(k, hashlib.md5(str(k).encode()).hexdigest(), "P", "NM_1", None, None) for k in range(1000)]
    m, r = spark.createDataFrame(models, MODELS), spark.createDataFrame(registry, REGISTRY)
    path = tmp_path / "t"
    sinks.write_annotation_parts(*annotation_etl.exon_parts(m, r), str(path), 3)
    assert sum(f.stat().st_size for f in path.rglob("*") if f.is_file()) < 1_000_000
    assert {f.name for f in (path / "segments").iterdir() if f.is_dir()} == {"contig=c", "contig=d"}
    whole = sorted(map(tuple, annotation_etl.exon_table(m, r).collect()))
    assert len(whole) == 2000 and sorted(map(tuple, readers.annotation_table_of_parts(spark, str(path)).collect())) == whole
    some = readers.annotation_table_of_parts(spark, str(path), spark.createDataFrame([("d", 1), ("x", 2)], "contig string, n int").filter("n > 0"))
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(map(tuple, some.collect())) == [x for x in whole if x[0] == "d"]
