"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib

import pytest

import corpus_pipeline
from depthwise.llm import quality
from test_joins import brute_components, brute_lines


def test_stages(spark, words, tmp_path):
    r = random.Random(12)
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(r.randint(8, 20))) for _ in range(n))
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(5)]
    good = [text(r.randint(2, 5)) for _ in range(120)]
    good += [g.replace(" ", "  ", 3) for g in good[:5]]  # equal words, other bytes
    good += [text(2) + "\n" + items[k][1] for k in range(5)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:60]]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(good + bad)] + [(900, None, "en", "src0", None), (901, "", None, None, 0)]
    labels = [(k, int(k < len(good)), 0) for k in range(len(good) + len(bad)) if k % 3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    model = {x.doc_id: x.predicted for x in quality.judged(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert set(seen["quality"]) == {d for d, p in model.items() if p} and not any(len(good) <= d < 900 for d in seen["quality"])
    assert seen["lines"] == brute_lines(sorted((d, t) for d, t in seen["quality"].items()))
    groups = brute_components([(d, t) for d, t in seen["lines"].items()])
    assert set(seen["near_duplicates"]) == {c for _, c in groups.values()}
    assert set(seen["benchmark"]) == {d for d in seen["near_duplicates"] if not any(t in (seen["near_duplicates"][d] or "") for _, t in items)}

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen["benchmark"])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    empty = [p for p in pieces if not seen["benchmark"][p.doc_id]]
    assert all(p.ids_crc32 == zlib.crc32(b"\0\0\0\0") for p in empty)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, at, rows, labels=(), items=(), more=()):
    spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", *more).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_no_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("more", [(), ("1 as id", "2 as no", "'k' as key", "3 as n", "0.5 as score", "'l' as label", "4 as start", "5 as item_id", "'x' as __id")])
def test_empty_labels_and_benchmark_and_clashing_columns(spark, tmp_path, words, more):
    r = random.Random(3)
    text = lambda: "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(3))
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else "s", len(t)) for k, t in enumerate(text() for _ in range(20))]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, rows[0][1], "en", "s", 3), rows[1], (None, "no id at all here", "en", "s", 17)]
    tables(spark, tmp_path, rows, more=more)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns, name
    kept = [(x.doc_id, x.text) for x in docs.collect()]
    # nothing is rejected, the copy loses its lines and stays as a document without words
    assert {d for d, _ in kept} == {*range(23), None} and dict(kept)[22] == "" and dict(kept)[20] is None
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in kept}
