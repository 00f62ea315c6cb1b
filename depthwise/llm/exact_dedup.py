"""Exact duplicates, with the frequent texts split off.

Two texts are equal when they are identical after each run of white space has become one space; the SHA-256 of that form is the
text's digest. Where one text makes up much of the corpus, a shuffle by digest sends all its rows to one task, so:

- Each task keeps a Misra-Gries summary of COUNTERS digests over the rows that it reads. The summaries are added up and the count
  of the one past the last counter is taken off all, which leaves at most COUNTERS candidates; among them is every digest that
  more than one row in COUNTERS + 1 has.
- The candidates are counted exactly, with the smallest id of each (sums that are combined before the shuffle). Those that are as
  frequent as that are the heavy ones. At most COUNTERS rows can be heavy, so that table is broadcast, and their rows are settled
  where they are read.
- All other rows go through one shuffle by digest, in which no digest can have more than that share of the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded, free_name, materialize

#: Counters of a summary, and the bound of the broadcast table of heavy digests (50 bytes each).
COUNTERS = 1024
#: Bound of a broadcast list of digests of rows that repeat with their id.
FEW_ROWS = 500_000
#: Runs of white space that aren't one space already.
_RUNS = "[\\t\\n\\x0B\\f\\r][\\x20\\t\\n\\x0B\\f\\r]*|\\x20[\\x20\\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _summaries(k: int):
    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = batch.column(0).value_counts()  # a batch at once, not row by row
            counts = merged(counts, dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return run


def merged(a: dict, b: dict, k: int) -> dict:
    """The sum of two Misra-Gries summaries (or of one and exact counts) as one of k counters: the count past the k-th is taken off
    all. A counter is then too low by at most 1 / (k + 1) of all that was counted."""
    both = dict(a)
    for x, n in b.items():
        both[x] = both.get(x, 0) + n
    if len(both) <= k:
        return both
    least = sorted(both.values(), reverse=True)[k]
    return {x: n - least for x, n in both.items() if n > least}


def heavy_hitters(rows: DataFrame, column: str = "digest", counters: int = COUNTERS) -> DataFrame:
    """(column, n): at most `counters` values of a binary column, with a lower bound of their number; every value is there that
    more than 1 / (counters + 1) of the rows have."""
    found = rows.filter(F.col(column).isNotNull()).select(column).mapInArrow(_summaries(counters), "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    top = materialize(found.orderBy(F.desc("n"), "digest").limit(counters + 1), "summary")
    past = top.agg(F.when(F.count("*") > counters, F.min("n")).otherwise(0).alias("past"))
    return top.join(F.broadcast(past)).filter(F.col("n") > F.col("past")).select(F.col("digest").alias(column), (F.col("n") - F.col("past")).alias("n"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: of rows with equal texts that with the smallest id is kept.

    Null texts are empty ones and equal to each other. Of rows that share the smallest id, one is kept. A null id comes last, and
    keep_id is null where a group has no other. Other columns are ignored. Without rows there are none.
    """
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "digests")  # from here on the texts are not read again, and row numbers are fixed
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    total = rows.count()
    candidates = heavy_hitters(rows, counters=counters).select("digest")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    heavy = materialize(exact.filter(F.col("size") * (counters + 1) > total), "heavy")  # at most `counters` rows
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    w = Window.partitionBy("digest")
    rest = marked.filter("size is null").select("id", "digest", "row", F.min(place).over(w).alias("first"), F.count("*").over(w).alias("size"))
    out = marked.filter("size is not null").select("id", "digest", "row", "first", "size").unionByName(rest)
    return out.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that are kept, whole. Rows that share an id and a text are told apart by nothing: the first that comes to
    hand stays. The ids of dropped rows are broadcast only behind a check of their number."""
    found = materialize(groups(docs, id_col, text_col, counters), "groups")
    sha, key, gone = (free_name(docs, n) for n in ("__sha", "__id", "__gone"))
    marked = docs.withColumn(sha, F.lower(F.hex(digest(F.col(text_col)))))
    dropped = found.filter(~F.col("kept") & ~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias(key), F.col("text_sha256").alias(gone)).distinct()
    dropped = bounded(dropped, FEW_ROWS, "dropped")
    left = marked.join(dropped, marked[id_col].eqNullSafe(dropped[key]) & (marked[sha] == dropped[gone]), "left_anti")
    again = bounded(found.filter(~F.col("kept") & F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col("text_sha256").alias(sha)).distinct(), FEW_ROWS, "again")
    if again.isEmpty():
        return left.drop(sha)
    once = left.join(again, sha, "left_semi").dropDuplicates([id_col, sha])
    return left.join(again, sha, "left_anti").unionByName(once).drop(sha)
