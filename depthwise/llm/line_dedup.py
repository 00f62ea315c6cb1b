"""Removal of repeated lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-cased words. A line goes if an earlier one (smaller id, or same text and smaller line number) is
similar. The join orders the tokens of each line by rarity and looks for tokens that stand next to each other in both lines: two
where both are rare, else three. Two similar lines have few tokens that the other lacks, and each of these parts at most two pairs or
three triples of neighbours, so that some near the front are the same in both: the prefix filter bounds how far from the front, the
length filter the sizes, and 64 bits of parity of each line's tokens how many tokens the two can differ in. The Jaccard similarity is
then verified on the whole sets. Below, "pair" is the key of such neighbours, two or three.

How it scales: equal lines are one member of the join. Rarity comes from counts of all tokens in 2**18 hash buckets, a table of
fixed size that stands in the plan as one small number a bucket. A token is written as its bucket's level and 55 bits of its
hash in one number, so that numbers sort by rarity and no join is needed to rank them. Which tokens are rare goes by the root of
the number of all words, so that two rare ones seldom meet by chance, whatever the data's size; neighbours are much rarer than
tokens, so that most stand in one line only and go no further. A line is compared with the first line at each of its pairs and
with some just before it; one that is similar to none of them goes on to all earlier lines of its pairs, and by then the large
families of similar lines are settled. The words of two lines are compared only if the parities of their tokens allow it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .storage import bounded, free_name, materialize

THRESHOLD = 0.8
#: Lines with fewer different words are left alone; 1: those without words.
SHORTEST = 1
BUCKETS = 1 << 18
#: Bounds of broadcast tables, in lines; a line takes a dozen bytes there.
FEW_LINES = 1_000_000
#: Stands twice behind the last token of a line.
END = (1 << 31) - 1
RARE_BREAKS = "\t\x0b\x0c\r"
#: A token is rare if its bucket's count is at most RARE times the root of all words, but 12 at least.
RARE = 1 / 16
#: In one number of a token: its level above bits of its hash. Number of those bits for sorting, and in what is kept of it.
LEVEL, KEPT_LEVEL = 55, 24
#: Rows of pairs of tokens are dealt with in up to so many slices, each of at least so many rows.
SLICES, SLICE_ROWS = 2, 4_000_000
#: Lines just before a line, of those that have the same pair of tokens, that it is compared with first.
BEFORE = 4
#: Shared pairs of tokens that a row of a line knows of before its own; two lines that have one of them in common meet there.
KNOWN = 16


def _words(text: Column, lines: bool = False) -> Column:
    """Lower-cased words of a line, or a text of several lines, with empty ones between breaks in a row. A split at one plain
    character takes no regular expression; the rare breaks are replaced before it, where there are any."""
    rare = reduce(Column.__or__, (text.contains(c) for c in RARE_BREAKS))
    breaks = RARE_BREAKS + "\n" * lines
    plain = F.replace(text, F.lit("\n"), F.lit(" ")) if lines else text
    return F.split(F.lower(F.when(rare, F.translate(text, breaks, " " * len(breaks))).otherwise(plain)), " ")


def _tokens(line: Column) -> Column:
    """Hashes of the distinct lower-cased words of a line."""
    hashes = F.transform(_words(line), lambda w: F.xxhash64(w))
    return F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ranked(tokens: Column, levels: Column) -> Column:
    """Tokens as (level of the bucket, hash) in one number, rarest first."""
    # without nulls Spark sorts plain numbers
    level = lambda t: F.shiftleft(F.coalesce(F.get(levels, _bucket(t)), F.lit(0).cast("bigint")), LEVEL)
    return F.sort_array(F.transform(tokens, lambda t: level(t).bitwiseOR(F.shiftrightunsigned(t, 64 - LEVEL))))


def _levels(texts: DataFrame) -> Column:
    """For each bucket its level: 0 for rare ones, then three steps for each doubling. The table is one literal of BUCKETS numbers,
    whatever the data's size."""
    words = texts.select(F.explode(_words(F.col("text"), lines=True)).alias("w"))
    counted = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count("*").alias("c"))
    rare = F.greatest(F.sqrt(F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0))), F.lit(0))) * RARE, F.lit(12.0))
    level = F.when(F.col("c") > rare, F.least(F.lit(127), 1 + F.floor(3 * F.log2(F.col("c") / rare)))).otherwise(F.lit(0)).cast("int")
    every = texts.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce(level, F.lit(0)).alias("level"))
    table = dense.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "level"))), lambda s: s["level"])).alias("table")).first().table
    return F.from_json(F.lit(table), "array<bigint>")


def _differ(threshold: float, total: Column) -> Column:
    """How many tokens two similar lines of `total` tokens together may not have in common."""
    return total - 2 * F.ceil(total * (threshold / (1 + threshold)) - 1e-9).cast("int")


def _rare(token: Column) -> Column:
    return token < 1 << KEPT_LEVEL


def _keys(threshold: float, n: Column, rare: Column) -> Column:
    """How many keys a line of n tokens needs from the front, of which `rare` are rare, to have one in common with each similar line.

    A similar line lacks at most b = n * (1 - threshold) of its tokens; each that it has instead counts as `threshold` of one of these.
    One that is missing parts two keys among the rare tokens and three behind them, so that b part up to 2 b keys if some among the
    rare - 1 first stay whole. Else parting all of these takes (rare - 1) / 2 of b, and the rest parts three each."""
    b = (1 - threshold) * n + 1e-9
    return F.floor(F.greatest(2 * b, 3 * b - F.greatest(rare - 1, F.lit(0)) / 2)).cast("int") + 1


def _fits(threshold: float, x: str, y: str) -> Column:
    """Whether two lines (columns n, parity with the prefixes x and y) can be similar. Each token that one of them lacks changes one
    bit of the parities, so that these differ in no more bits than the lines in tokens."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    most = _differ(threshold, n + m)
    return (F.abs(n - m) <= most) & (F.bit_count(F.col(f"{x}parity").bitwiseXOR(F.col(f"{y}parity"))) <= most)


def _numbered(own: DataFrame) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """own with a bigint `place` that is in order of (id, no), and what turns a column of places into columns id and no again. Where
    ids aren't whole numbers, or their range is too wide for both to fit, lines are numbered by a sort of their ids."""
    kind = own.schema["id"].dataType
    if isinstance(kind, IntegralType):
        low, high, last = own.agg(F.min("id"), F.max("id"), F.max("no")).first()
        low, bits = low or 0, (last or 0).bit_length()
        if ((high or 0) - low + 1) << bits < 1 << 63:
            place = F.shiftleft(F.col("id").cast("bigint") - low, bits).bitwiseOR(F.col("no").cast("bigint"))
            there = lambda df, c: df.withColumns({"id": (F.shiftright(c, bits) + low).cast(kind), "no": F.col(c).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")})
            return own.withColumn("place", place), there
    numbers = materialize(own.select("id", "no").sort("id", "no").withColumn("place", F.monotonically_increasing_id()), "numbers")
    return own.join(numbers, ["id", "no"]), lambda df, c: df.join(numbers.withColumnRenamed("place", c), c)


def _similar(texts: DataFrame, pairs: DataFrame, there: Callable[[DataFrame, str], DataFrame], threshold: float) -> DataFrame:
    """Places of the lines b of the pairs (a, b) that are similar on the whole sets."""
    pairs = materialize(pairs, "pairs")
    wanted = there(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct(), "place")
    wanted = materialize(wanted.groupBy("id").agg(F.collect_list(F.struct("place", "no")).alias("spots")), "wanted")
    few = (wanted.agg(F.sum(F.size("spots") + 1)).first()[0] or 0) <= FEW_LINES
    picked = texts.join(F.broadcast(wanted) if few else wanted, "id").select(F.split("text", "\n").alias("lines"), "spots")
    picked = picked.select(F.explode(F.transform("spots", lambda s: F.struct(s["place"].alias("place"), F.get("lines", s["no"]).alias("line")))).alias("s"))
    picked = picked.select("s.place", _tokens(F.col("s.line")).alias("set")).dropDuplicates(["place"])
    a, b = (picked.select(F.col("place").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    sets = pairs.join(a, "a").join(b, "b")
    sizes = sets.select("b", (F.size("set_a") + F.size("set_b")).alias("total"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    enough = F.col("both") * 10_000 >= round(threshold * 10_000) * (F.col("total") - F.col("both"))
    return materialize(sizes.filter(enough).select("b").distinct(), "similar")


def line_decisions(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """(id, no) of the lines to remove."""
    if not 0.75 <= threshold <= 1:
        raise ValueError("threshold must be from 0.75 to 1")
    shortest = max(shortest, 1)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    # the size is filtered only behind the exchange, else the tokens would be made once more for the filter
    sets = lines.select("id", "no", _ranked(_tokens(F.col("line")), _levels(texts)).alias("ranked"))
    n = F.size("ranked")
    kept = lambda t: F.shiftright(t, LEVEL - KEPT_LEVEL).cast("int")
    most = F.floor(3 * (1 - threshold) * n + 1e-9).cast("int") + 3
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))
    sets = sets.select(
        "id", "no", n.alias("n"), F.xxhash64("ranked").alias("key"), F.xxhash64(F.lit(1), "ranked").alias("key2"),
        F.concat(F.transform(F.slice("ranked", 1, most), kept), F.array(F.lit(END), F.lit(END))).alias("head"),
        F.aggregate("ranked", F.lit(0).cast("bigint"), lambda x, t: x.bitwiseXOR(bit(t))).alias("parity"),
    )
    sets = sets.withColumn("head", F.slice("head", 1, _keys(threshold, F.col("n"), F.size(F.filter("head", _rare))) + 2))
    equal = Window.partitionBy("key", "key2").orderBy("id", "no")
    own = sets.withColumn("turn", F.row_number().over(equal)).filter((F.col("turn") == 1) | (F.col("n") >= shortest))
    own = materialize(own.select("id", "no", "n", (F.col("turn") > 1).alias("equal"), *(F.when(F.col("turn") == 1, F.col(c)).alias(c) for c in ("head", "parity"))), "lines")

    # below so many tokens only equal lines are similar
    members = own.filter(~F.col("equal") & (F.col("n") >= max(shortest, int(threshold / (1 - threshold) + 1e-9) if threshold < 1 else 1 << 30)))
    members, there = _numbered(members)
    shared = _shared(members)
    lines = members.select("place", "n", "parity")
    of = lambda k: lines.select(F.col("place").alias(k), F.struct("n", "parity").alias(f"of_{k}"))
    twos = shared.filter("k = 2").select(F.col("low").alias("a"), F.col("place").alias("b")).distinct()
    twos = twos.join(of("a"), "a").join(of("b"), "b").filter(_fits(threshold, "of_a.", "of_b.")).select("a", "b")

    order = Window.partitionBy("pair").orderBy("place")
    line = F.struct("place", "n", "parity")
    seen = {"turn": F.row_number().over(order), "first": F.first(line).over(order)} | {f"last{k}": F.lag(line, k).over(order) for k in range(1, BEFORE + 1)}
    # turn k has only k - 1 lines before it
    near = [F.when((F.col("turn") > max(k, 1)) & _fits(threshold, f"{c}.", ""), F.col(f"{c}.place")) for k, c in enumerate(["first", *list(seen)[2:]])]
    crowd = shared.filter("k > 2").select("pair", "place").join(lines, "place").withColumns(seen)
    crowd = materialize(crowd.select("pair", "place", "n", "parity", "turn", F.array_compact(F.array_distinct(F.array(*near))).alias("near")), "crowd")
    some = crowd.filter(F.size("near") > 0).select(F.explode("near").alias("a"), F.col("place").alias("b"))
    tried = materialize(twos.unionByName(some).distinct(), "tried")
    found = _similar(texts, tried, there, threshold)
    # lines up to this turn have no others before them than those tried
    left = crowd.filter(F.col("turn") > BEFORE + 2).select("pair", "place", "n", "parity", "turn").join(bounded(found.withColumnRenamed("b", "place"), FEW_LINES, "found"), "place", "left_anti")
    rest = _rest(crowd.filter("turn > 1").drop("near"), left, threshold).distinct().join(tried, ["a", "b"], "left_anti")
    found = found.unionByName(_similar(texts, rest, there, threshold))
    return materialize(own.filter("equal").select("id", "no").unionByName(there(found, "b").select("id", "no")).distinct(), "gone")


def _rest(crowd: DataFrame, left: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of lines b that are left and lines a of crowd before them, beyond those tried, that may be similar.

    Lines of a family have many pairs of tokens in common; two lines meet at the first of these only. Each row has the KNOWN pairs
    of its line before its own, and two rows with one of them in common make nothing: either the two lines meet there, or they have been
    tried. A row knows a bounded number, so that lines with more of them can meet more than once, but never less."""
    known = F.collect_list("pair").over(Window.partitionBy("place").orderBy("pair").rowsBetween(-KNOWN, -1))
    left = materialize(left, "left")
    y = bounded(left.withColumn("known", known), FEW_LINES // 4, "left").alias("y")
    wanted = bounded(left.groupBy("pair").agg(F.max("turn").alias("last")), FEW_LINES // 4, "wanted")
    x = crowd.join(wanted, "pair").filter(F.col("turn") + BEFORE < F.col("last")).drop("last").withColumn("known", known).alias("x")
    both = (F.col("x.pair") == F.col("y.pair")) & (F.col("x.turn") + BEFORE < F.col("y.turn")) & _fits(threshold, "x.", "y.")
    met = F.arrays_overlap("x.known", "y.known")
    return x.join(y, both & ~met).select(F.col("x.place").alias("a"), F.col("y.place").alias("b"))


def _shared(members: DataFrame) -> DataFrame:
    """(pair, place, k, low) of the keys that k > 1 lines have, the first of them at `low`; if k is 2, of the second line only. Keys are
    dealt with in slices, one after the other, so that only one slice's rows are on disk at once."""
    x, y, z = (F.get("head", F.col("i") + k) for k in range(3))
    # a hash of a null is that of what is before it
    pair = F.xxhash64(x, y, F.when(~(_rare(x) & _rare(y)), z))
    every = members.select("place", "head", F.explode(F.sequence(F.lit(0), F.size("head") - 3)).alias("i")).select(pair.alias("pair"), "place")
    count = members.agg(F.sum(F.size("head") - 2)).first()[0] or 0
    slices, done = min(SLICES, 1 + count // SLICE_ROWS), []
    for k in range(slices):
        rows = every.filter(F.pmod("pair", F.lit(slices)) == k).repartition("pair")
        often = rows.groupBy("pair").agg(F.count("*").alias("k"), F.min("place").alias("low"), F.max("place").alias("high")).filter("k > 1")
        mine = rows.join(often.hint("shuffle_hash"), "pair").filter("k > 2 or place = high").select("pair", "place", "k", "low")
        done.append(materialize(mine, "shared"))
    return reduce(DataFrame.unionByName, done)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """docs with the later lines removed from the text, and columns n_lines, n_removed (replaced if there are such).

    What is earlier counts, removed or not, so the result does not depend on the order of work. Lines of fewer than `shortest`
    different words stay, and always those without words. A text whose lines all go is empty; a null text stays null and has no
    lines; an empty one has one line. Ids should be unique: of rows that share an id, the lines at one place count as one.
    Lines of rows with a null id stay.
    """
    gone = line_decisions(docs, id_col, text_col, threshold, shortest)
    key, lost = free_name(docs, "__id"), free_name(docs, "__gone")
    runs = gone.groupBy(F.col("id").alias(key)).agg(F.collect_list("no").alias(lost))
    joined = docs.join(F.broadcast(runs) if gone.count() <= FEW_LINES else runs, docs[id_col] == runs[key], "left")
    # the lines are a column of their own, used more than once, so that Spark splits a text once and not for each of its lines
    lines = free_name(joined, "__lines")
    joined = joined.withColumn(lines, F.when(F.col(lost).isNotNull(), F.split(F.col(text_col), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    kept = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda no: F.get(lines, no)), "\n"))
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    counts = {
        "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(breaks + 1).cast("bigint"),
        "n_removed": F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("bigint"),
    }
    return joined.withColumns(counts).withColumn(text_col, kept).drop(key, lost, lines)
