"""Annotation tables from gene models and the gene name registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import plain_contig, primary, source_of
from ..storage import stored
from .annotate import SOURCES
from .intervals import overlap_join, partition


def exon_rows(models: DataFrame) -> DataFrame:
    """(name, contig, strand, symbol, exon_id, start, end, cds_start, cds_end, cds_length): a row for each exon. Ids count along
    the strand from 0. Non-coding models (empty CDS) take the transcript's bounds."""
    coding = F.col("cds_start") < F.col("cds_end")
    low, high = F.when(coding, F.col("cds_start")).otherwise(F.col("tx_start")), F.when(coding, F.col("cds_end")).otherwise(F.col("tx_end"))
    exons = F.arrays_zip(F.col("exon_starts").alias("s"), F.col("exon_ends").alias("e"))
    inside = F.aggregate(exons, F.lit(0), lambda total, x: total + F.greatest(F.least(x["e"], F.col("c1")) - F.greatest(x["s"], F.col("c0")), F.lit(0)))
    rows = models.withColumns({"c0": low, "c1": high, "coding": coding}).withColumn("cds_length", inside)
    rows = rows.select("name", "contig", "strand", "symbol", "coding", "c0", "c1", "cds_length", "exon_count", F.posexplode(exons).alias("k", "x"))
    number = F.when(F.col("strand") == "-", F.col("exon_count") - F.col("k") - 1).otherwise(F.col("k"))
    return rows.select("name", "contig", "strand", "symbol", "coding", number.cast("int").alias("exon_id"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("c0").alias("cds_start"), F.col("c1").alias("cds_end"), "cds_length")


def coding_exons(models: DataFrame) -> DataFrame:
    """Exon rows of coding models, without predicted ones (XM_) and exons outside of the CDS."""
    rows = exon_rows(models.filter(~F.col("name").startswith("XM_") & (F.col("cds_start") < F.col("cds_end"))))
    return rows.filter((F.col("end") > F.col("cds_start")) & (F.col("start") < F.col("cds_end")))


def cds_coordinates(models: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(contig, cds_start, cds_end, gene, transcript, exon_id, length): exons clipped to the CDS, on plain primary contigs;
    versions of Ensembl ids go; a missing symbol comes from the registry."""
    rows = coding_exons(models).filter(primary(F.col("contig")))
    name = F.when(F.col("name").startswith("E"), F.regexp_replace("name", r"\.[0-9]+$", "")).otherwise(F.col("name"))
    rows = rows.withColumns({"name": name, "start": F.greatest("start", "cds_start"), "end": F.least("end", "cds_end")})
    gene = F.col("symbol")
    if registry is not None:
        rows = rows.join(registry_lookup(registry).filter("source = 'refseq'").groupBy(F.col("id").alias("name")).agg(F.min("symbol").alias("known")), "name", "left")
        gene = F.coalesce("symbol", "known")
    return rows.select(plain_contig(F.col("contig")).alias("contig"), F.col("start").alias("cds_start"), F.col("end").alias("cds_end"), F.coalesce(gene, F.lit(".")).alias("gene"), F.col("name").alias("transcript"), "exon_id", F.col("cds_length").cast("bigint").alias("length"))


def introns(models: DataFrame) -> DataFrame:
    """(name, contig, gene, intron_id, start, end): the gaps between consecutive exons."""
    gaps = F.transform(F.sequence(F.lit(1), F.col("exon_count") - 1), lambda i: F.struct(i.cast("int").alias("intron_id"), F.get("exon_ends", i - 1).alias("start"), F.get("exon_starts", i).alias("end")))
    return models.filter("exon_count > 1").select("name", "contig", F.coalesce("symbol", F.lit(".")).alias("gene"), F.inline(gaps)).filter("start < end")


def registry_lookup(registry: DataFrame) -> DataFrame:
    """(source, id, hgnc_id, symbol, prev): a row for each id in the registry's lists, to be joined by equality."""
    columns = {"refseq": "refseq", "ccds": "ccds", "vega": "vega", "ensembl": "vega", "ucsc": "ccds", "mirbase": "mirna"}
    def ids(c: str, source: str):
        return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.struct(F.lit(source).alias("source"), F.trim(x).alias("id")))

    lists = [ids(c, source) for c, source in columns.items() if c in registry.columns]
    return registry.select("hgnc_id", "symbol", "prev", F.inline(F.concat(*lists))).filter("id <> ''").select("source", "id", "hgnc_id", "symbol", "prev")


def named(rows: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """rows with hgnc_symbol and hgnc_prev of their id (version and suffix aside), of the entry with the lowest number."""
    ids = registry_lookup(registry).groupBy("source", "id").agg(F.min_by(F.struct("symbol", "prev"), "hgnc_id").alias("r"))
    keyed = rows.withColumns({"source": source_of(F.col(name)), "id": F.regexp_replace(F.substring_index(F.col(name), ".", 1), "-[0-9]+$", "")})
    return keyed.join(ids, ["source", "id"], "left").withColumns({"hgnc_symbol": F.col("r.symbol"), "hgnc_prev": F.col("r.prev")}).drop("source", "id", "r")


def unique_names(models: DataFrame, name: str = "name") -> DataFrame:
    """Models with -1, -2, ... after names that occur again, in order of contig and start."""
    w = Window.partitionBy(name).orderBy("contig", "tx_start", "tx_end")
    k = F.row_number().over(w) - 1
    return models.withColumn("__k", k).withColumn(name, F.when(F.col("__k") > 0, F.concat_ws("-", name, F.col("__k").cast("string"))).otherwise(F.col(name))).drop("__k")


#: What a name begins with -> the registry's list that has such ids, and the table's column for them.
PREFIXES = (("N", "refseq", "refseq"), ("X", "refseq", "refseq"), ("uc", "ucsc", "vega"), ("EN", "ensembl", "vega"), ("OTT", "vega", "vega"), ("CCDS", "ccds", "ccds"), ("hsa", "mirbase", "mirna"))


def _by_prefix(name: Column, which: int, otherwise: str | None) -> Column:
    out = F.when(F.lit(False), "")
    for row in PREFIXES:
        out = out.when(name.startswith(row[0]), row[which])
    return out.otherwise(F.lit(otherwise))


def _ids(name: Column, registry: DataFrame) -> Column:
    """`list:id` of a name, null for a name that none of the registry's lists can have. Versions are left off, and of RefSeq ids
    the number that tells equal names apart."""
    kind, plain = _by_prefix(name, 1, None), F.substring_index(name, ".", 1)
    return F.when(kind.isin(*_lists(registry)), F.concat(kind, F.lit(":"), F.when(kind == "refseq", F.regexp_replace(plain, "-[0-9]+$", "")).otherwise(plain)))


def _lists(registry: DataFrame) -> list[str]:
    return sorted({row[1] for row in PREFIXES} & set(registry.columns))


def entries_of_ids(registry: DataFrame) -> DataFrame:
    """(id, symbol, prev): a row for each `list:id` of each registry entry."""
    ids = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.struct(F.lit(f"{c}:").alias("list"), F.trim(x).alias("id")))
    return registry.select("symbol", "prev", F.inline(F.concat(*map(ids, _lists(registry))))).filter("id <> ''").select(F.concat("list", "id").alias("id"), "symbol", "prev")


def exon_parts(models: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exon table as segments and lists, to be put together by `whole_table`."""
    rows = exon_rows(models).select("contig", "start", "end", "name", "symbol", F.concat("name", F.lit("|exon_"), F.col("exon_id").cast("string"), F.lit("|gene")).alias("label"))
    return _parts(rows, partition(rows), registry)


def exon_table(models: DataFrame, registry: DataFrame) -> DataFrame:
    """(contig, start, end, symbol, synonyms, prev, refseq, ccds, vega, mirna, other): disjoint segments of the exons. Of the
    symbols that the models over a segment and the registry give, the first is the symbol, the others are synonyms; the models'
    labels `name|exon_<id>|gene` stand in the column of their kind. Lists are sorted, distinct and joined by semicolons; null
    where there is nothing."""
    return whole_table(*exon_parts(models, registry))


def intron_table(models: DataFrame, registry: DataFrame) -> DataFrame:
    """As exon_table, for what introns cover and no exon does; previous symbols that are symbols of the segment are left out."""
    rows = introns(models).select("contig", "start", "end", "name", F.col("gene").alias("symbol"), F.concat("name", F.lit("|intron_"), F.col("intron_id").cast("string"), F.lit("|gene")).alias("label"))
    return whole_table(*_parts(rows, partition(rows, outside=exon_rows(models)), registry, only_new=True))


#: Segments of one set of ids that meet one copy of its lists.
SEGMENTS_OF_A_COPY = 4_000


def _parts(rows: DataFrame, segments: DataFrame, registry: DataFrame, only_new: bool = False) -> tuple[DataFrame, DataFrame]:
    """The segments (contig, start, end, ids, own, copy, five kinds), written once, with the ids of the names over them and those of
    the models' own symbols that the registry does not give for the model's id; and for each different set of ids (ids, copy) its
    lists: symbols, its first symbol, its synonyms as text, prevs, these as text.

    An id may have very many symbols and be that of very many models: only ids are shuffled with the segments, and lists are made
    once for each set of ids. A set of more than SEGMENTS_OF_A_COPY segments has several copies of its lists, so that its segments needn't
    meet them in one task.
    """
    good = lambda c: ~F.col(c).isin("", ".")
    entries = entries_of_ids(registry)
    given = entries.filter(good("symbol")).select("id", "symbol", F.lit(True).alias("given")).distinct()
    keyed = rows.select("contig", "start", "end", "label", _by_prefix(F.col("name"), 2, "other").alias("kind"), _ids(F.col("name"), registry).alias("id"), F.when(good("symbol"), F.col("symbol")).alias("symbol"))
    keyed = keyed.join(given, ["id", "symbol"], "left").select("contig", "start", "end", "label", "kind", "id", F.when(F.col("given").isNull(), F.col("symbol")).alias("own"))
    pairs = overlap_join(segments.select("contig", "start", "end"), keyed)
    kinds = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("b_kind") == k, F.col("b_label")))), ";").alias(k) for k in SOURCES]
    sets = [F.array_sort(F.collect_set(f"b_{c}")).alias(n) for c, n in (("id", "ids"), ("own", "own"))]
    found = pairs.groupBy("contig", "start", "end").agg(*sets, *kinds).withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in SOURCES})
    found = stored(found, "segments")

    counts = found.filter("size(ids) > 0").groupBy("ids").agg(F.ceil(F.count("*") / SEGMENTS_OF_A_COPY).cast("int").alias("copies"))
    large = counts.filter("copies > 1")  # at most a row for each SEGMENTS_OF_A_COPY segments
    dealt = found.join(F.broadcast(large), "ids", "left").withColumn("copy", F.pmod(F.xxhash64("contig", "start"), F.coalesce("copies", F.lit(1))).cast("int"))
    of_ids = entries.groupBy("id").agg(*(F.sort_array(F.collect_set(F.when(good(c), F.col(c)))).alias(f"{c}s") for c in ("symbol", "prev")))
    all_of = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    lists = counts.select("ids", "copies", F.explode("ids").alias("id")).join(of_ids, "id").groupBy("ids", "copies").agg(all_of("symbols"), all_of("prevs"))
    if only_new:
        lists = lists.withColumn("prevs", F.array_except("prevs", "symbols"))
    lists = lists.select("ids", "copies", "symbols", F.get("symbols", F.lit(0)).alias("symbol"), _joined(F.slice("symbols", 2, 1 << 30)).alias("synonyms"), "prevs", _joined(F.col("prevs")).alias("prev"), F.lit(only_new).alias("only_new"))
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.select("contig", "start", "end", "ids", "own", "copy", *SOURCES), lists


def _joined(c: Column) -> Column:
    """A list as text, null if it is empty."""
    return F.when(F.size(c) > 0, F.array_join(c, ";"))


def whole_table(segments: DataFrame, lists: DataFrame) -> DataFrame:
    """The table of the segments with their lists. Own symbols, which few segments have, are put into the lists here; a long list
    is not hashed for that, but searched for each of them and sorted, being in order but for their end."""
    none = F.expr("cast(array() as array<string>)")
    found = segments.join(lists, ["ids", "copy"], "left").withColumn("symbols", F.coalesce("symbols", none))
    found = found.withColumn("new", F.filter("own", lambda x: ~F.array_contains("symbols", x)))
    more = F.size("new") > 0
    found = found.withColumn("genes", F.when(more, F.sort_array(F.concat("symbols", "new"))))
    prevs = F.array_except("prevs", "own")
    return found.select(
        "contig", "start", "end", F.when(more, F.get("genes", F.lit(0))).otherwise(F.col("symbol")).alias("symbol"),
        F.when(more, F.when(F.size("genes") > 1, F.array_join(F.slice("genes", 2, 1 << 30), ";"))).otherwise(F.col("synonyms")).alias("synonyms"),
        F.when(more & F.col("only_new"), _joined(prevs)).otherwise(F.col("prev")).alias("prev"), *SOURCES,
    )
