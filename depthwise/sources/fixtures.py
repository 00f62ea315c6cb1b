"""Tables of the data model derived from the TPC-H-like test tables.

Each is one SQL text that Spark and DuckDB both run, so that queries and their checks start from equal rows. `{x}` stands for
a table; the few dialect differences are filled in by `sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import stored

#: The genome grows with the reads, so that depth stays alike at every scale.
CONTIGS = "SELECT contig, CAST(base * {scale} AS INT) AS length, ordinal FROM (VALUES ('chr1', 24000, 0), ('chr2', 20000, 1), ('chr3', 16000, 2), ('chr4', 12000, 3), ('chrX', 18000, 4), ('chrY', 8000, 5)) AS t(contig, base, ordinal)"
#: Reads for each time that the base lengths count.
READS = 60_000

ALIGNMENTS = """
WITH base AS (
  SELECT {spread}c.contig, c.length AS clen, CAST((l_orderkey * 7919 + l_partkey * 104729) % c.length AS INT) AS pos, 50 + CAST(l_quantity AS INT) AS n,
    CAST(l_orderkey AS BIGINT) AS ok, CAST(l_partkey AS BIGINT) AS pk, CAST(l_linenumber AS INT) AS ln, l_returnflag AS rf, CAST((l_orderkey + l_partkey) % 401 AS INT) - 200 AS isize
  FROM {lineitem} JOIN ({contigs}) c ON c.ordinal = l_suppkey % 6)
SELECT contig, pos, CAST(pk % 61 AS INT) AS mapq,
  CAST(CASE WHEN ln <> 7 THEN 1 ELSE 0 END + CASE WHEN ln <> 7 AND rf <> 'R' THEN 2 ELSE 0 END + CASE WHEN pk % 97 = 0 THEN 4 ELSE 0 END
    + CASE WHEN pk % 53 = 0 THEN 8 ELSE 0 END + CASE WHEN pk % 41 = 0 THEN 256 ELSE 0 END + CASE WHEN pk % 89 = 1 THEN 512 ELSE 0 END
    + CASE WHEN FLOOR(pos / 500.0) % 7 = 3 AND ln >= 2 THEN 1024 ELSE 0 END + CASE WHEN pk % 37 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
  CASE ln % 5 WHEN 0 THEN concat(n, 'M') WHEN 1 THEN concat('5S', n - 5, 'M') WHEN 2 THEN concat('20M2I', n - 22, 'M') WHEN 3 THEN concat('20M3D', n - 20, 'M') ELSE concat('10=', n - 20, 'X10M') END AS cigar,
  n AS l_qseq, CASE WHEN pk % 29 = 0 THEN 'chr1' ELSE contig END AS mate_contig,
  CAST(CASE WHEN isize > 0 THEN GREATEST(0, pos + isize - n) ELSE GREATEST(0, pos + isize) END AS INT) AS mate_pos, isize,
  CASE WHEN pk % 3 = 0 THEN NULL ELSE concat(n, 'M') END AS mc, concat('r', ok, ':', ln) AS qname, pk, ok, ln{more}
FROM base"""

#: Every row of part belongs to a place, a target to each place of a contig that has rows.
PLACES = """
SELECT c.contig, c.length, CAST(FLOOR(p_partkey / 6.0) AS INT) % CAST(FLOOR(c.length / 400.0) AS INT) AS place, p_partkey, CAST(p_size AS INT) AS p_size, p_brand FROM {part} JOIN ({contigs}) c ON c.ordinal = p_partkey % 6"""

TARGETS = """
WITH t AS (SELECT contig, length, place, MIN(p_partkey) AS interval_id, place * 400 + MIN(p_size) AS s, place * 400 + MIN(p_size) + 50 + MAX(p_size) * 3 AS e FROM ({places}) p GROUP BY contig, length, place)
SELECT k.set_id, contig, s AS {start}, e AS {end}, interval_id FROM t CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS v(set_id)) k WHERE e < length AND (k.set_id = 0 OR interval_id % 2 = 0)"""

N_REGIONS = """
SELECT contig, 0 AS {start}, 300 AS {end} FROM ({contigs}) a
UNION ALL SELECT contig, CAST(FLOOR(length / 2.0) AS INT), CAST(FLOOR(length / 2.0) AS INT) + 1500 FROM ({contigs}) b"""

CDS = """
WITH t AS (SELECT x.contig, GREATEST(x.{start} - 30 - p.p_size % 7, 0) AS s, x.{end} + 15 AS e, p.p_brand AS gene, p.p_partkey AS k0, p.p_size FROM ({targets}) x JOIN ({places}) p ON p.contig = x.contig AND p.place = CAST(FLOOR(x.interval_id / 6.0) AS INT) WHERE x.set_id = 0)
SELECT contig, s AS {start}, e AS {end}, gene, concat(k.prefix, k0 % 50) AS transcript, CAST(CASE WHEN p_size % 17 = 0 THEN -1 WHEN p_size % 13 = 0 THEN -2 - FLOOR(k0 / 6.0) ELSE FLOOR(k0 / 6.0) END AS INT) AS exon_id,
  CASE WHEN p_size % 17 = 0 THEN 'snp' WHEN p_size % 19 = 0 THEN 'miRNA' ELSE 'gene' END AS type
FROM t JOIN (SELECT * FROM (VALUES ('NM_', 1), ('NR_', 2)) AS v(prefix, every)) k ON k0 % k.every = 0"""

SAMPLE_REGIONS = """
SELECT CAST(user_id % 8 AS INT) AS sample_id, c.contig, CAST((event_id * 7919) % (c.length - 400) AS INT) AS {start},
  CAST((event_id * 7919) % (c.length - 400) AS INT) + 20 + CAST(FLOOR(value) AS INT) % 300 AS {end}
FROM {events} JOIN ({contigs}) c ON c.ordinal = event_id % 6"""

GENE_MODEL = """
SELECT {name} AS name, contig, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, t0 AS tx_start, t0 + n * 300 + 120 AS tx_end,
  CASE WHEN s_suppkey % 10 = 9 THEN t0 + n * 300 + 120 ELSE t0 + 40 END AS cds_start, CASE WHEN s_suppkey % 10 = 9 THEN t0 + n * 300 + 120 ELSE t0 + n * 300 + 80 END AS cds_end,
  n + 1 AS exon_count, {exon_starts} AS exon_starts, {exon_ends} AS exon_ends, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS symbol
FROM (SELECT s_suppkey, s_name, c.contig, CAST((s_suppkey * 731) % (c.length - 2000) AS INT) AS t0, CAST(s_suppkey % 4 AS INT) + 1 AS n FROM {supplier} JOIN ({contigs}) c ON c.ordinal = s_suppkey % 6) s"""

REGISTRY = """
SELECT s_suppkey AS hgnc_id, concat('G', s_suppkey) AS symbol, CASE WHEN s_suppkey % 2 = 1 THEN NULL ELSE concat('P', s_suppkey) END AS prev,
  concat('NM_', s_suppkey % 40, ',NM_', (s_suppkey + 1) % 40) AS refseq FROM {supplier}"""

#: The gene models again, with names of all kinds, and a registry with lists of each.
MODEL_NAMES = """concat(CASE s_suppkey % 8 WHEN 0 THEN 'NM_' WHEN 1 THEN 'XR_' WHEN 2 THEN 'CCDS' WHEN 3 THEN 'ENST0' WHEN 4 THEN 'OTTHUMT0' WHEN 5 THEN 'uc0' WHEN 6 THEN 'hsa-mir-' ELSE 'pseudo' END, s_suppkey % 40, CASE WHEN s_suppkey % 8 = 3 THEN '.2' ELSE '' END)"""

GENES = """
SELECT s_suppkey AS hgnc_id, s_name AS symbol, concat('A', s_suppkey % 30, ',Supplier#', lpad(CAST(s_suppkey + 6 AS STRING), 9, '0')) AS alias, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE concat('P', s_suppkey % 50) END AS prev,
  concat('ENST0', s_suppkey % 40) AS ensembl, concat('OTTHUMT0', s_suppkey % 40, ',OTTHUMT0', (s_suppkey + 2) % 40) AS vega, concat('uc0', s_suppkey % 40) AS ucsc, concat('NM_', s_suppkey % 40, ',XR_', (s_suppkey + 1) % 40) AS refseq,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('CCDS', s_suppkey % 40) END AS ccds, concat('hsa-mir-', s_suppkey % 40) AS mirbase FROM {supplier}"""

_SPARK = {
    "start": "`start`", "end": "`end`",
    "exon_starts": "transform(sequence(0, n), k -> t0 + k * 300)", "exon_ends": "transform(sequence(0, n), k -> t0 + k * 300 + 120)",
    "more": ", monotonically_increasing_id() AS read_id, transform(sequence(0, n - 1), i -> CAST((pk * 31 + i * 17) % 42 AS TINYINT)) AS quals",
}
_DUCKDB = {
    "start": "s0", "end": "e0",
    "exon_starts": "list_transform(range(0, n + 1), lambda k: t0 + k * 300)", "exon_ends": "list_transform(range(0, n + 1), lambda k: t0 + k * 300 + 120)",
    "more": ", row_number() OVER () AS read_id, list_transform(range(0, n), lambda i: CAST((pk * 31 + i * 17) % 42 AS TINYINT)) AS quals",
}
NAMES = {"contigs": CONTIGS, "alignments": ALIGNMENTS, "targets": TARGETS, "n_regions": N_REGIONS, "cds": CDS, "sample_regions": SAMPLE_REGIONS, "gene_model": GENE_MODEL, "registry": REGISTRY, "models": GENE_MODEL, "genes": GENES}


def sql(name: str, spark: bool = False, scale: str | None = None) -> str:
    """SQL of a derived table; in DuckDB's the interval columns are s0 and e0."""
    words = _SPARK if spark else _DUCKDB
    tables = {t: t for t in ("lineitem", "part", "events", "supplier")}
    contigs = CONTIGS.format(scale=scale or f"(SELECT greatest(1, count(*) // {READS}) FROM lineitem)")
    places = PLACES.format(**tables, contigs=contigs)
    spread = f"/*+ REPARTITION({scale}) */ " if spark else ""
    return NAMES[name].format(**words, **tables, name=MODEL_NAMES if name == "models" else "concat('NM_', s_suppkey % 40)", scale=scale, spread=spread, contigs=contigs, places=places, targets=TARGETS.format(**words, contigs=contigs, places=places)) if name != "contigs" else contigs


_scales: dict[str, int] = {}
_written: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Those of many uses are written once in a session: as input files they have columns of their own, which
    filters can be pushed to, instead of long expressions that each use would repeat."""
    if name not in ("alignments", "targets", "cds"):
        return _derived(spark, sf_dir, name)
    at = spark.sparkContext.applicationId, sf_dir, name
    if at not in _written:
        _written[at] = stored(_derived(spark, sf_dir, name), name)
    return _written[at]


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if sf_dir not in _scales:
        _scales[sf_dir] = max(1, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // READS)
    text = sql(name, spark=True, scale=str(_scales[sf_dir]))
    for t in ("lineitem", "part", "events", "supplier"):
        text = text.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet` AS {t}").replace(f"JOIN {t} ", f"JOIN parquet.`{sf_dir}/{t}.parquet` ")
    return spark.sql(text)
