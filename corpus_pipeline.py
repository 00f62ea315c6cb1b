"""A corpus from documents to packed windows: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between two
stages the table is written and read again, so that a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthwise.llm import decontaminate, line_dedup, ngram_join, packing, quality
from depthwise.llm.storage import documents, materialize

#: Rows of a batch between Spark and a Python worker. In one session the workers and Spark's buffers of all stages add up; batches of
#: Spark's 10,000 rows are tens of MB of text on either side of each.
ARROW_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to ARROW_ROWS, unless it has fewer. It has to stay so until the stage has run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts have the score of a text without any indicator; equal
    texts have equal scores, so that copies and repeated rows go or stay together. Without labels of both classes every score is
    the share of label 1, and 0.5 without any, so that all documents stay or all go."""
    _small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat earlier ones; one whose lines all go stays, with an empty text. A null text
    stays null, with a length of 0. Of lines that are equally similar to a later one none is chosen: the later one goes if there
    is any. Lines of rows that share an id count once for each place; rows with a null id stay as they are."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Documents without words are like no other; rows
    that repeat an id stay or go together; rows with a null id stay."""
    _small_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; rows that repeat an id go if one of them holds a
    passage; rows with a null id stay. An empty benchmark, or null items, match nothing."""
    _small_batches(spark)
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens. A null or empty text is the one token that ends each document; repeated
    rows are documents of their own; a null source is a source."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]
#: None: SQL cannot express the classifier or the token ids; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
