"""SQL for DuckDB that gives the rows of the registered queries by other means: it expands everything to single bases or plain
joins and shares no algorithm with the operators."""

from __future__ import annotations

from ..functions.columns import THRESHOLDS
from ..sources import fixtures

USED = "flag & (4 | 256 | 512 | 1024 | 2048) = 0"
PIECES = """CASE ln % 5 WHEN 0 THEN [{'o': 0, 'n': n, 'q': 0}] WHEN 1 THEN [{'o': 0, 'n': n - 5, 'q': 5}]
  WHEN 2 THEN [{'o': 0, 'n': 20, 'q': 0}, {'o': 20, 'n': n - 22, 'q': 22}] WHEN 3 THEN [{'o': 0, 'n': 20, 'q': 0}, {'o': 23, 'n': n - 20, 'q': 20}]
  ELSE [{'o': 0, 'n': 10, 'q': 0}, {'o': 10, 'n': n - 20, 'q': 10}, {'o': n - 10, 'n': 10, 'q': n - 10}] END"""


def _with(*names: str, used: str = USED) -> str:
    """A WITH clause of the parts named and those they need."""
    parts = {
        "contigs": ("", fixtures.sql("contigs")),
        "targets": ("", fixtures.sql("targets")),
        "n_regions": ("", fixtures.sql("n_regions")),
        "cds": ("", fixtures.sql("cds")),
        "sample_regions": ("", fixtures.sql("sample_regions")),
        "gene_model": ("", fixtures.sql("gene_model")),
        "registry": ("", fixtures.sql("registry")),
        "models": ("", fixtures.sql("models")),
        "genes": ("", fixtures.sql("genes")),
        "mexons": ("models", "SELECT name, contig, symbol, CASE WHEN strand = '-' THEN exon_count - k - 1 ELSE k END AS exon_id, s0, e0 FROM (SELECT *, unnest(range(0, exon_count)) AS k, unnest(exon_starts) AS s0, unnest(exon_ends) AS e0 FROM models)"),
        "mintrons": ("models", "SELECT name, contig, coalesce(symbol, '.') AS symbol, j AS intron_id, exon_ends[j] AS s0, exon_starts[j + 1] AS e0 FROM (SELECT *, unnest(range(1, exon_count)) AS j FROM models)"),
        "lists": ("genes", " UNION ALL ".join(f"SELECT '{c}' AS kind, symbol, prev, unnest(string_split({c}, ',')) AS id FROM genes" for c in ("refseq", "ucsc", "ensembl", "vega", "ccds", "mirbase"))),
        "typed": ("models", "SELECT name, CASE WHEN name[1] IN ('N', 'X') THEN 'refseq' WHEN name LIKE 'uc%' THEN 'ucsc' WHEN name LIKE 'EN%' THEN 'ensembl' WHEN name LIKE 'OTT%' THEN 'vega' WHEN name LIKE 'CCDS%' THEN 'ccds' WHEN name LIKE 'hsa%' THEN 'mirbase' END AS kind, string_split(name, '.')[1] AS id FROM (SELECT DISTINCT name FROM models)"),
        "al": ("contigs", f"SELECT a.*, l_qseq AS n, c.length AS clen, c.ordinal FROM ({fixtures.sql('alignments')}) a JOIN contigs c ON c.contig = a.contig"),
        "ends": ("al", "SELECT *, pos + CASE ln % 5 WHEN 1 THEN n - 5 WHEN 2 THEN n - 2 WHEN 3 THEN n + 3 ELSE n END AS rend, isize > 0 AND contig = mate_contig AS pair, mate_pos + n AS mend FROM al"),
        "mated": ("ends", f"""SELECT *, CASE WHEN pair AND mc IS NOT NULL AND rend > mate_pos AND mend > pos THEN least(rend, mend) - greatest(pos, mate_pos)
            WHEN pair AND mc IS NULL AND (pos > mate_pos OR rend > mate_pos) THEN rend - greatest(pos, mate_pos) ELSE 0 END AS shared,
            coalesce(pair AND mc IS NOT NULL AND mate_pos <= pos AND rend <= mend, false) AS inside FROM ends WHERE {used}"""),
        "segs": ("al", f"SELECT * EXCLUDE (u), u.o AS o, u.n AS k, u.q AS q FROM (SELECT *, unnest({PIECES}) AS u FROM al WHERE {used}) WHERE pos + u.o < clen"),
        "msegs": ("mated", f"SELECT * EXCLUDE (u), u.o AS o, u.n AS k, u.q AS q FROM (SELECT *, unnest({PIECES}) AS u FROM mated WHERE NOT inside)"),
        "bases": ("segs", "SELECT contig, read_id, unnest(range(pos + o, least(pos + o + k, clen))) AS p FROM segs"),
        "all_pos": ("contigs", "SELECT contig, unnest(range(0, length)) AS p FROM contigs"),
        "in_n": ("n_regions", "SELECT DISTINCT contig, unnest(range(s0, e0)) AS p FROM n_regions"),
        "depth": ("bases all_pos in_n", "SELECT a.contig, a.p, CASE WHEN i.p IS NULL THEN coalesce(c.d, 0) ELSE 0 END AS d, i.p IS NOT NULL AS in_n FROM all_pos a LEFT JOIN (SELECT contig, p, count(*) AS d FROM bases GROUP BY 1, 2) c ON c.contig = a.contig AND c.p = a.p LEFT JOIN in_n i ON i.contig = a.contig AND i.p = a.p"),
        "tpos": ("targets", "SELECT set_id, contig, interval_id, s0, e0, unnest(range(s0, e0)) AS p FROM targets"),
        "tdepth": ("tpos depth", "SELECT t.*, d.d FROM tpos t JOIN depth d ON d.contig = t.contig AND d.p = t.p"),
        "flank": ("targets contigs tpos", "SELECT DISTINCT f.set_id, f.contig, f.p FROM (SELECT set_id, t.contig, unnest(list_concat(range(greatest(s0 - 100, 0), s0), range(e0 + 1, least(e0 + 101, c.length)))) AS p FROM targets t JOIN contigs c ON c.contig = t.contig) f ANTI JOIN tpos t ON t.set_id = f.set_id AND t.contig = f.contig AND t.p = f.p"),
        "counts": ("al", f"""SELECT count(*) AS reads_produced, count(*) FILTER (good) AS reads_aligned, count(*) FILTER (good AND flag & 1 > 0) AS reads_paired, count(*) FILTER (good AND flag & 1 > 0 AND flag & 8 = 0) AS mapped_mate,
            count(*) FILTER (good AND flag & 1024 > 0) AS duplicates, count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2 > 0) AS proper, count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2 = 0) AS chimeric,
            count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2048 > 0) AS supplementary, sum(n) FILTER (good) AS mapped_bases,
            (SELECT n FROM al WHERE {used} ORDER BY ordinal, pos, n LIMIT 1) AS read_length FROM (SELECT *, flag & (4 | 256 | 512) = 0 AS good FROM al)"""),
        "low": ("tdepth", "SELECT DISTINCT contig, p FROM tdepth WHERE set_id = 0 AND d < 20"),
        "cds_rows": ("cds low", """SELECT x.*, x.e0 - x.s0 AS length, coalesce(y.n, 0) AS low_bases, y.regions FROM (SELECT contig, gene, transcript, max(exon_id) AS exon_id, s0, e0 FROM cds GROUP BY contig, gene, transcript, s0, e0) x LEFT JOIN (
            SELECT contig, gene, transcript, exon_id, s0, e0, sum(e - s) AS n, string_agg(concat(s, '-', e), ';' ORDER BY s) AS regions FROM (
              SELECT contig, gene, transcript, exon_id, s0, e0, min(p) AS s, max(p) + 1 AS e FROM (
                SELECT c.contig, c.gene, c.transcript, c.exon_id, c.s0, c.e0, l.p, l.p - row_number() OVER (PARTITION BY c.contig, c.gene, c.transcript, c.exon_id, c.s0, c.e0 ORDER BY l.p) AS g0
                FROM (SELECT contig, gene, transcript, max(exon_id) AS exon_id, s0, e0 FROM cds GROUP BY contig, gene, transcript, s0, e0) c JOIN low l ON l.contig = c.contig AND l.p >= c.s0 AND l.p < c.e0) GROUP BY contig, gene, transcript, exon_id, s0, e0, g0) GROUP BY ALL) y
            USING (contig, gene, transcript, exon_id, s0, e0)"""),
        "tx_rows": ("cds_rows", "SELECT contig, gene, transcript, sum(length) AS length, count(*) AS n_cds, (sum(length) - sum(CASE WHEN exon_id < -1 THEN length ELSE low_bases END)) * 100.0::DOUBLE / sum(length) AS pct FROM cds_rows GROUP BY ALL"),
        "spos": ("sample_regions", "SELECT DISTINCT sample_id, contig, unnest(range(s0, e0)) AS p FROM sample_regions"),
        "often": ("spos", "SELECT contig, p FROM spos GROUP BY ALL HAVING count(*) >= (SELECT floor(count(DISTINCT sample_id) * 40 / 100.0 + 0.4) FROM sample_regions)"),
        "bex": ("cds often", """SELECT x.*, x.e0 - x.s0 AS length, least(coalesce(y.n, 0), x.e0 - x.s0) AS low_bases FROM (SELECT DISTINCT contig, gene, transcript, exon_id, s0, e0 FROM cds) x LEFT JOIN
            (SELECT c.contig, c.gene, c.transcript, c.exon_id, count(DISTINCT o.p) AS n FROM cds c JOIN often o ON o.contig = c.contig AND o.p >= c.s0 AND o.p < c.e0 GROUP BY ALL) y USING (contig, gene, transcript, exon_id)"""),
        "btx": ("bex", "SELECT contig, gene, transcript, sum(length) AS length, count(*) AS n_exons, (sum(length) - sum(low_bases)) * 100.0::DOUBLE / sum(length) AS pct FROM bex GROUP BY ALL"),
        "cpos": ("cds", "SELECT contig, transcript, s0, e0, unnest(range(s0, e0)) AS p FROM cds"),
        "exons": ("gene_model", "SELECT name, contig, strand, symbol, exon_count, cds_start, cds_end, tx_start, tx_end, unnest(range(0, exon_count)) AS k, unnest(exon_starts) AS s0, unnest(exon_ends) AS e0 FROM gene_model"),
        "ids": ("registry", "SELECT hgnc_id, symbol, prev, unnest(string_split(refseq, ',')) AS id FROM registry"),
        "known": ("ids", "SELECT id, arg_min(symbol, hgnc_id) AS symbol, arg_min(struct_pack(v := prev), hgnc_id).v AS prev FROM ids GROUP BY id"),
    }
    order: list[str] = []

    def need(name: str) -> None:
        for other in parts[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{name} AS ({parts[name][1]})" for name in order)


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0 ELSE floor(CAST({part} AS DOUBLE) / {whole} * 10000 + 0.5) / 100 END"


def _runs(source: str, keys: str, cls: str, value: str = "") -> str:
    """Runs of consecutive positions p of equal class: keys, class, start_pos, end_pos and the sum of value."""
    k = f"{keys}, " if keys else ""
    more = f", sum({value}) AS total" if value else ""
    return f"SELECT {k}{cls} AS cls, CAST(min(p) AS BIGINT) AS start_pos, CAST(max(p) + 1 AS BIGINT) AS end_pos{more} FROM (SELECT *, p - row_number() OVER (PARTITION BY {k}{cls} ORDER BY p) AS g FROM {source}) GROUP BY {k}{cls}, g"


def _breadth(depth: str, keys: str, total: str, less: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {keys}CAST({t} AS BIGINT) AS threshold, count(*) FILTER (d {'=' if t == 0 else '>='} {t}){f' - {less}' if t == 0 else ''} AS n_bases FROM {depth} {f'GROUP BY {keys[:-2]}' if keys else ''}" for t in THRESHOLDS
    )
    return f"SELECT {keys}threshold, n_bases, {_pct('n_bases', total)} AS pct FROM ({each})"


CDS_PCT = "CASE WHEN exon_id < -1 THEN 0.0::DOUBLE ELSE CAST((length - low_bases) * 100.0 AS DOUBLE) / length END"
GENOME = "(SELECT count(*) FILTER (NOT in_n) FROM depth)"
NS = "(SELECT count(*) FROM in_n)"
MEAN = "CAST(floor(total * 1.0 / (end_pos - start_pos) + 0.5) AS BIGINT)"
CLASS30 = "CASE WHEN d < 1 THEN 0 WHEN d <= 30 THEN 1 ELSE 2 END"
CLASS150 = "CASE WHEN d < 1 THEN 0 WHEN d <= 150 THEN 1 ELSE 2 END"


def _union(rows: list[tuple[str, str]], source: str, keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}" for name, value in rows)


def _read_rows() -> list[tuple[str, str]]:
    rows = [("Total_Reads", "reads_produced"), ("Sequenced_Read_Length", "read_length"), ("Total_Yield", "read_length * reads_produced"), ("Aligned_Reads", "reads_aligned"), ("PCT_Reads_Aligned", _pct("reads_aligned", "reads_produced"))]
    for name, v in (("Unique_Aligned_Reads", "(reads_aligned - duplicates)"), ("Duplicate_Reads", "duplicates"), ("Supplementary_Reads", "supplementary"), ("Paired_Reads", "reads_paired"), ("Paired_Reads_With_Mapped_Mates", "mapped_mate"), ("Properly_Paired_Reads", "proper"), ("Chimeric_Reads", "chimeric")):
        rows += [(name, v), (f"PCT_of_{name}_TR", _pct(v, "reads_produced")), (f"PCT_of_{name}_AR", _pct(v, "reads_aligned"))]
    return rows


def _breadth_rows(total: str, zero: str = "") -> list[tuple[str, str]]:
    v = lambda t: f"(t{t}{zero if t == 0 else ''})"
    return [(f"Bases_with_{t}x_coverage", v(t)) for t in THRESHOLDS] + [(f"PCT_of_Bases_with_{t}x_coverage", _pct(v(t), total)) for t in THRESHOLDS]


WIDE = ", ".join(f"count(*) FILTER (d {'=' if t == 0 else '>='} {t}) AS t{t}" for t in THRESHOLDS)


def _median(depth: str, keys: str, half: str, where: str = "") -> str:
    """Smallest depth whose running count reaches half."""
    k = f"PARTITION BY {keys} " if keys else ""
    out = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {out}min(d) AS median FROM (SELECT {out}d, sum(c) OVER ({k}ORDER BY d) AS run, {half} AS half FROM (SELECT {out}d, count(*) {where} AS c FROM {depth} GROUP BY {out}d)) WHERE run >= half {group}"


def _wgs_summary() -> str:
    q = lambda t: f"(SELECT sum(len(list_filter(quals[q + 1 : q + least(pos + o + k, clen) - pos - o], lambda x: x >= {t}))) FROM segs) + (SELECT coalesce(sum(len(list_filter(quals[21:22], lambda x: x >= {t}))), 0) FROM al WHERE {USED} AND ln % 5 = 2 AND pos + 20 < clen)"
    facts = f"""facts AS (SELECT c.*, f.*, {GENOME} AS bases, {NS} AS n_total, (SELECT count(*) FROM bases) AS unique_bases, m.median, {q(20)} AS q20, {q(30)} AS q30, {q(40)} AS q40
        FROM counts c, (SELECT sum(d) AS total, max(d) AS top, {WIDE} FROM depth) f, ({_median('depth', '', 'floor((SELECT count(*) FILTER (NOT in_n) FROM depth) / 2)', 'FILTER (NOT in_n)')}) m)"""
    rows = _read_rows() + [
        ("Average_Coverage", f"{_pct('total', 'bases')} / 100"), ("WGS_Max_Coverage", "top"), ("Number_of_Bases_with_WGS_Max_Coverage", "(SELECT count(*) FROM depth WHERE d = top)"), ("Total_Genome_Base_Targeted_wo_Ns", "bases"),
        ("Total_Ns_Bases_in_Ns_Regions", "n_total"), ("Total_Mapped_Bases", "mapped_bases"), ("Total_Uniquely_Aligned_Bases", "unique_bases"), ("Total_Overlapped_Aligned_Bases", "0"), ("PCT_Overlapped_Aligned_Bases", "0"), ("Median_Coverage", "median"),
    ]
    for t in (20, 30, 40):
        rows += [(f"Aligned_Q{t}_Bases", f"q{t}"), (f"PCT_Aligned_Q{t}_Bases", _pct(f"q{t}", "mapped_bases"))]
    return f"{_with('depth', 'counts')}, {facts} {_union(rows + _breadth_rows('bases', ' - n_total'), 'facts')}"


CLASSES = """SELECT t.set_id, a.read_id, max(CASE WHEN x.p IS NOT NULL THEN 2 WHEN f.p IS NOT NULL THEN 1 ELSE 0 END) AS c
  FROM (SELECT DISTINCT set_id FROM targets) t CROSS JOIN bases a LEFT JOIN tpos x ON x.set_id = t.set_id AND x.contig = a.contig AND x.p = a.p LEFT JOIN flank f ON f.set_id = t.set_id AND f.contig = a.contig AND f.p = a.p GROUP BY ALL"""


def _off_target(targets: str, pad: int) -> str:
    """Positions outside of the padded targets of the sets up to each; runs of depth, from the first base over 20 on."""
    return f"""pads AS (SELECT DISTINCT k.set_id, t.contig, unnest(range(greatest(t.s0 - {pad}, 0), t.e0 + {pad} + 1)) AS p FROM {targets} t JOIN (SELECT DISTINCT set_id FROM {targets}) k ON t.set_id <= k.set_id),
      free AS (SELECT k.set_id, d.contig, d.p, d.d FROM (SELECT DISTINCT set_id FROM {targets}) k CROSS JOIN depth d ANTI JOIN pads ON pads.set_id = k.set_id AND pads.contig = d.contig AND pads.p = d.p WHERE d.d > 0),
      hot AS (SELECT set_id, contig, CAST(min(p) FILTER (d > 20) AS BIGINT) AS start_pos, CAST(max(p) + 1 AS BIGINT) AS end_pos, max(d) AS max_depth
        FROM (SELECT *, p - row_number() OVER (PARTITION BY set_id, contig ORDER BY p) AS g FROM free) GROUP BY set_id, contig, g HAVING max(d) > 20)"""


def _capture_summary() -> str:
    facts = f"""cls AS ({CLASSES}), {_off_target('targets', 500)},
      per AS (SELECT set_id, sum(d) AS total, max(d) AS top, count(*) AS bases, {WIDE} FROM tdepth GROUP BY set_id),
      hit AS (SELECT set_id, interval_id, contig, s0, max(d) > 0 AS hit FROM tdepth GROUP BY ALL),
      near AS (SELECT DISTINCT h.set_id, h.interval_id FROM hit h JOIN depth d ON d.contig = h.contig AND d.p >= h.s0 - 100 AND d.p < h.s0 AND d.d > 0 WHERE NOT h.hit),
      facts AS (SELECT p.*, m.median, c.reads_aligned, (SELECT count(*) FROM tdepth x WHERE x.set_id = p.set_id AND x.d = p.top) AS at_top,
        (SELECT count(*) FROM cls WHERE cls.set_id = p.set_id AND cls.c = 2) AS on_target, (SELECT count(*) FROM cls WHERE cls.set_id = p.set_id AND cls.c = 1) AS in_buffer, (SELECT count(*) FROM cls WHERE cls.set_id = p.set_id AND cls.c = 0) AS off,
        (SELECT count(*) FROM hit WHERE hit.set_id = p.set_id) AS n_targets, (SELECT count(*) FROM hit WHERE hit.set_id = p.set_id AND hit.hit) AS n_hit, (SELECT count(*) FROM near WHERE near.set_id = p.set_id) AS n_near,
        (SELECT count(*) FROM hot WHERE hot.set_id = p.set_id) AS n_hot, (SELECT count(*) FROM flank WHERE flank.set_id = p.set_id) AS buffer_bases
      FROM per p JOIN ({_median('tdepth', 'set_id', 'floor((sum(c) OVER (PARTITION BY set_id)) / 2)')}) m ON m.set_id = p.set_id CROSS JOIN counts c)"""
    hit = "(on_target + in_buffer)"
    rows = [
        ("Average_Coverage", f"{_pct('total', 'bases')} / 100"), ("Aligned_Reads_On_Buffer", "in_buffer"), ("PCT_of_Aligned_Reads_On_Buffer", _pct("in_buffer", "reads_aligned")), ("Aligned_Reads_On_Target", "on_target"), ("PCT_of_Aligned_Reads_On_Target", _pct("on_target", "reads_aligned")),
        ("Median_Coverage", "median"), ("Target_Max_Coverage", "top"), ("Number_of_Bases_with_Target_Max_Coverage", "at_top"), ("Reads_that_hit_target_or_buffer", hit), ("PCT_of_Reads_that_hit_target_or_buffer", _pct(hit, "reads_aligned")),
        ("Off_Target_Reads", "off"), ("Total_Targets", "n_targets"), ("Targets_with_Coverage_Hit", "n_hit"), ("PCT_of_Targets_with_Coverage_Hit", _pct("n_hit", "n_targets")), ("Targets_with_Buffer_Hit_only", "n_near"),
        ("Non_target_regions_with_high_coverage", "n_hot"), ("Bases_Targeted", "bases"), ("Buffer_Bases", "buffer_bases"),
    ]
    return f"{_with('tdepth', 'flank', 'counts')}, {facts} {_union(rows + _breadth_rows('bases'), 'facts', 'set_id, ')}"


def _cohort(text: str) -> str:
    """The SQL of one sample for each of three, whose reads are told apart by the order's number."""
    join = "a JOIN contigs c ON c.contig = a.contig"
    return " UNION ALL ".join(f"SELECT 's{k}' AS sample, x.* FROM ({text.replace(join, f'{join} WHERE a.ok % 3 = {k}')}) x" for k in range(3))


def _files() -> dict[str, str]:
    """What the round trips through files must give: the derived tables themselves."""
    return {
        "read_sam": f"""{_with('al')} SELECT contig, count(*) AS n, sum(pos) AS pos, sum(mapq) AS mapq, sum(flag) AS flag, sum(l_qseq) AS l_qseq, sum(mate_pos) AS mate_pos, sum(isize) AS isize, count(mc) AS with_mc, sum(length(cigar)) AS cigar_length,
          sum(list_sum(quals)) AS quals, count(*) FILTER (mate_contig = contig) AS same_contig, count(DISTINCT qname) AS n_names, CAST(max(clen) AS BIGINT) AS length FROM al GROUP BY contig""",
        "read_contigs": f"""{_with('targets')}, c AS (SELECT concat('ctg', lpad(CAST(interval_id % 1000 AS VARCHAR), 3, '0')) AS contig, CAST(sum(e0) AS BIGINT) AS length FROM targets GROUP BY 1)
          SELECT contig, length, row_number() OVER (ORDER BY contig) - 1 AS ordinal, (SELECT CAST(sum(length) AS BIGINT) FROM c) AS genome_size FROM c""",
        "read_manifest": f"""{_with('targets', 'cds')} SELECT 'targets' AS kind, CAST(k AS BIGINT) AS set_id, contig, count(*) AS n, sum(s0) AS starts, sum(e0) AS ends, 0 AS exons FROM targets, range(4) r(k) WHERE set_id = 0 AND interval_id % 4 >= k GROUP BY k, contig
          UNION ALL SELECT 'annotation', k, contig, count(*), sum(s0), sum(e0), sum(exon_id) FROM cds JOIN (VALUES (0, 0), (1, 1), (2, 0)) v(k, part) ON (exon_id % 2 + 2) % 2 = part GROUP BY k, contig""",
        "read_gene_models": f"""{_with('gene_model')} SELECT name, contig, strand, CAST(tx_start AS BIGINT) AS tx_start, CAST(tx_end AS BIGINT) AS tx_end, CAST(cds_start AS BIGINT) AS cds_start, CAST(cds_end AS BIGINT) AS cds_end, CAST(exon_count AS BIGINT) AS exon_count,
          CAST(list_sum(exon_starts) AS BIGINT) AS starts, CAST(list_sum(exon_ends) AS BIGINT) AS ends, symbol FROM gene_model""",
        "read_registry": f"{_with('registry')} SELECT CAST(hgnc_id AS VARCHAR) AS hgnc_id, symbol, prev, refseq FROM registry",
        "read_mirna": f"{_with('cds')} SELECT contig, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, transcript, concat('M', exon_id) AS gene, type FROM cds WHERE type = 'miRNA'",
        "read_region_reports": f"{_with('sample_regions')} SELECT contig, count(DISTINCT sample_id) AS samples, count(*) AS n, sum(s0) AS starts, sum(e0) AS ends FROM sample_regions GROUP BY contig",
        "write_depth_text": f"""{_with('depth')}, l AS (SELECT contig, string_agg(CAST(d AS VARCHAR), ' ') AS text FROM depth GROUP BY contig, floor(p / 100.0))
          SELECT contig, 1 AS headers, count(*) + 1 AS n, CAST(sum(length(text)) + length(contig) + 1 AS BIGINT) AS characters FROM l GROUP BY contig""",
        "write_target_depth": f"{_with('tdepth')} SELECT set_id, contig, count(*) AS n, CAST(sum(p) AS BIGINT) AS positions, CAST(sum(d) AS BIGINT) AS depths FROM tdepth GROUP BY set_id, contig",
        "write_coverage_report": f"{_with('tx_rows')} SELECT contig, gene, transcript, CAST(length AS BIGINT) AS length, n_cds, pct FROM tx_rows",
        "write_wig": f"""{_with('depth', 'targets')}, {_off_target('targets', 30)} SELECT h.set_id, count(DISTINCT (h.contig, h.start_pos)) AS regions, count(*) AS bases, CAST(sum(d.d) AS BIGINT) AS depths
          FROM hot h JOIN depth d ON d.contig = h.contig AND d.p >= h.start_pos AND d.p < h.end_pos GROUP BY h.set_id""",
        "region_report": f"""{_with('depth', 'mexons', 'mintrons', 'genes')}, reg AS (SELECT contig, start_pos, end_pos, {MEAN} AS mean_depth FROM ({_runs('(SELECT * FROM depth WHERE d < 20)', 'contig', 'true', 'd')} UNION ALL {_runs('(SELECT * FROM depth WHERE d >= 60)', 'contig', 'true', 'd')})),
          k AS (SELECT name, CASE WHEN n LIKE '%nm!_%' ESCAPE '!' OR n LIKE '%nr!_%' ESCAPE '!' OR n LIKE '%xm!_%' ESCAPE '!' THEN 'refseq' WHEN n LIKE '%ccds%' OR n LIKE '%uc%' THEN 'ccds' WHEN n LIKE '%ott%' OR n LIKE '%enst%' THEN 'vega' WHEN n LIKE '%hsa-%' OR n LIKE '%mir%' THEN 'mirna' ELSE 'other' END AS src FROM (SELECT DISTINCT name, lower(name) AS n FROM models)),
          h AS (SELECT r.contig, r.start_pos, r.end_pos, coalesce(m.symbol, '.') AS gene, concat(m.name, '_cds_', m.exon_id) AS label, k.src FROM reg r JOIN mexons m ON m.contig = r.contig AND r.start_pos < m.e0 AND m.s0 < r.end_pos JOIN k ON k.name = m.name),
          i AS (SELECT DISTINCT ON (r.contig, r.start_pos, r.end_pos) r.contig, r.start_pos, r.end_pos, m.symbol AS gene, m.name AS label, k.src FROM (SELECT * FROM reg ANTI JOIN h USING (contig, start_pos, end_pos)) r JOIN mintrons m ON m.contig = r.contig AND r.start_pos < m.e0 AND m.s0 < r.end_pos JOIN k ON k.name = m.name ORDER BY r.contig, r.start_pos, r.end_pos, m.s0, m.symbol, m.name),
          a AS (SELECT * FROM h UNION ALL SELECT * FROM i), gn AS (SELECT DISTINCT contig, start_pos, end_pos, gene FROM a WHERE gene <> '.'),
          other AS (SELECT gn.*, unnest(list_concat(list_transform(string_split(g.alias, ','), lambda x: struct_pack(t := 's', x := x)), CASE WHEN g.prev IS NULL THEN [] ELSE [struct_pack(t := 'p', x := g.prev)] END)) AS o FROM gn JOIN genes g ON g.symbol = gn.gene),
          kept AS (SELECT DISTINCT contig, start_pos, end_pos, o.t AS t, o.x AS x FROM other WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.contig = other.contig AND gn.start_pos = other.start_pos AND gn.end_pos = other.end_pos AND gn.gene = other.o.x)),
          l1 AS (SELECT contig, start_pos, end_pos, string_agg(gene, ';' ORDER BY gene) AS genes FROM gn GROUP BY ALL),
          l2 AS (SELECT contig, start_pos, end_pos, string_agg(x, ';' ORDER BY x) FILTER (t = 's') AS synonyms, string_agg(x, ';' ORDER BY x) FILTER (t = 'p') AS prev FROM kept GROUP BY ALL),
          l3 AS (SELECT contig, start_pos, end_pos, {", ".join(f"string_agg(DISTINCT label, ';' ORDER BY label) FILTER (src = '{c}') AS {c}" for c in ("refseq", "ccds", "vega", "mirna", "other"))} FROM a GROUP BY ALL)
          SELECT row_number() OVER (ORDER BY ordinal, start_pos, end_pos) AS line, contig, start_pos, end_pos, end_pos - start_pos AS length, mean_depth, genes, synonyms, prev, refseq, ccds, vega, mirna, other
          FROM (SELECT reg.*, c.ordinal FROM reg JOIN contigs c ON c.contig = reg.contig) r LEFT JOIN l1 USING (contig, start_pos, end_pos) LEFT JOIN l2 USING (contig, start_pos, end_pos) LEFT JOIN l3 USING (contig, start_pos, end_pos)""",
        "annotation_tables": f"""WITH x AS ({_table(EXON_ROWS, False)}) SELECT contig, count(*) AS n, CAST(sum(start_pos) AS BIGINT) AS starts, CAST(sum(end_pos) AS BIGINT) AS ends, count(synonyms) AS with_synonyms,
          (SELECT count(DISTINCT string_split(name, '.')[1]) FROM ({fixtures.sql('models')})) AS names FROM x WHERE contig IN ('chr1', 'chr3', 'chrX') GROUP BY contig""",
        "gene_transcripts": f"{_with('cds')} SELECT DISTINCT gene, transcript FROM cds",
        "shared_contigs": f"{_with('sample_regions', 'contigs')} SELECT count(*) > 0 AS shared FROM sample_regions s SEMI JOIN contigs c ON c.contig = s.contig",
        "read_gene_list": f"{_with('cds')} SELECT gene, count(*) AS n FROM cds GROUP BY gene",
        "unsorted_annotations": f"""{_with('cds')}, l AS (SELECT gene, contig, s0, CASE WHEN (exon_id % 13 + 13) % 13 = 0 THEN s0 ELSE e0 END AS e0, concat_ws('|', gene, transcript, CASE WHEN exon_id % 11 <> 0 THEN concat('cds_', exon_id) END) AS a FROM cds),
          o AS (SELECT *, row_number() OVER w AS nr, lag(contig) OVER w AS c1, lag(s0) OVER w AS s1 FROM l WINDOW w AS (PARTITION BY gene ORDER BY e0, contig, s0, a)),
          f AS (SELECT gene, contig, min(nr) AS nr0 FROM o GROUP BY ALL),
          x AS (SELECT 'start not above the last' AS problem, contig, s0, e0 FROM o WHERE c1 = contig AND s1 >= s0
            UNION ALL SELECT 'contig comes again', o.contig, s0, e0 FROM o JOIN f ON f.gene = o.gene AND f.contig = o.contig WHERE c1 <> o.contig AND nr > nr0
            UNION ALL SELECT 'empty interval', contig, s0, e0 FROM o WHERE s0 >= e0 UNION ALL SELECT 'too few fields', contig, s0, e0 FROM o WHERE len(string_split(a, '|')) < 3)
          SELECT problem, contig, count(*) AS n, CAST(sum(s0) AS BIGINT) AS starts, CAST(sum(e0) AS BIGINT) AS ends FROM x GROUP BY ALL""",
        "read_coverage_blocks": f"""SELECT * FROM (WITH t AS ({_cohort(f"""{_with('depth')} SELECT contig, start_pos, end_pos, {MEAN} AS m FROM ({_runs("(SELECT * FROM depth WHERE contig = 'chr2')", 'contig', CLASS30, 'd')})""")}),
          k AS (SELECT * FROM t WHERE m > 0 OR sample <> 's1'), g AS (SELECT *, lag(end_pos) OVER (PARTITION BY sample ORDER BY start_pos) AS prev FROM k)
          SELECT sample, contig, start_pos AS pos, CASE WHEN m > 200 THEN 198 ELSE m END AS value FROM k UNION ALL SELECT sample, contig, unnest(range(prev, start_pos, 2000)), 0 FROM g WHERE prev < start_pos)""",
        "read_summary_reports": _cohort(f"""WITH w AS ({_wgs_summary()}), h AS ({_with('depth')} SELECT least(d, 1000) AS x, count(*) AS n FROM depth GROUP BY ALL),
          lim AS (SELECT CASE WHEN value <= 30 THEN 60 WHEN value <= 55 THEN 100 WHEN value <= 80 THEN 150 WHEN value <= 120 THEN 200 WHEN value <= 160 THEN 250 ELSE 300 END AS k FROM w WHERE metric = 'Average_Coverage')
          SELECT metric, round(value, 3) AS value FROM w UNION ALL SELECT concat('depth_', r.k), round(coalesce(h.n, 0) * 100.0::DOUBLE / (SELECT sum(n) FROM h), 6) FROM (SELECT unnest(range(0, (SELECT k + 1 FROM lim))) AS k) r LEFT JOIN h ON h.x = r.k"""),
    }


def oracle_sql() -> dict[str, str]:
    low_hit = USED + " AND mapq >= 58"
    overlap_bases = "SELECT contig, unnest(range(pos + o, least(pos + o + k, clen))) AS p, pair, mc, mate_pos, mend, shared FROM msegs"
    kept = "shared = 0 OR p < mate_pos OR (mc IS NOT NULL AND p >= mend)"
    regions = f"merged AS ({_runs('(SELECT DISTINCT contig, p FROM spos)', 'contig', 'true')})"

    sql = {
        "wgs_breadth": f"{_with('depth')} {_breadth('depth', '', GENOME, NS)}",
        "wgs_depth_rle": f"{_with('depth')} SELECT contig, start_pos, end_pos, cls AS depth FROM ({_runs('depth', 'contig', 'd')})",
        "wgs_histogram": f"{_with('depth')} SELECT CAST(r.k AS BIGINT) AS depth, count(d.d) AS n_bases FROM (SELECT unnest(range(0, 1001)) AS k) r LEFT JOIN depth d ON least(d.d, 1000) = r.k GROUP BY r.k",
        "wgs_summary": _wgs_summary(),
        "depth_summary": f"{_with('depth')} SELECT {GENOME} AS bases, CAST(sum(d) AS BIGINT) AS sum_depth, sum(d) / {GENOME} AS mean_depth, max(m.median) AS median_depth, max(d) AS max_depth, (SELECT count(*) FROM depth WHERE d = (SELECT max(d) FROM depth)) AS bases_at_max FROM depth, ({_median('depth', '', f'floor({GENOME} / 2)', 'FILTER (NOT in_n)')}) m",
        "n_region_bases": f"""{_with('in_n', 'tpos')}, x AS (SELECT -1 AS set_id, contig FROM in_n UNION ALL SELECT set_id, contig FROM tpos)
          SELECT set_id, count(*) AS n_total, count(*) FILTER (contig = 'chrX') AS n_x, count(*) FILTER (contig = 'chrY') AS n_y FROM x GROUP BY set_id""",
        "read_stats": f"{_with('counts')} {_union(_read_rows(), 'counts')}",
        "read_stats_by_contig": f"""{_with('al')}, x AS (SELECT *, flag & 4 = 0 AND mapq >= 10 AND flag & 512 = 0 AND flag & 256 = 0 AS good FROM al)
          SELECT contig, count(*) AS reads_produced, count(*) FILTER (good) AS reads_aligned, count(*) FILTER (good AND flag & 1 > 0) AS reads_paired, count(*) FILTER (good AND flag & 1 > 0 AND flag & 8 = 0) AS paired_with_mapped_mate, count(*) FILTER (good AND flag & 1024 > 0) AS duplicate_reads,
          count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2 > 0) AS proper_paired, count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2 = 0) AS chimeric_reads, count(*) FILTER (good AND flag & 1024 = 0 AND flag & 2048 > 0) AS supplementary_reads, CAST(sum(n) FILTER (good) AS BIGINT) AS mapped_bases FROM x GROUP BY contig""",
        "read_length": f"{_with('counts')} SELECT CAST(read_length AS BIGINT) AS read_length FROM counts",
        "cigar_blocks": f"""{_with('segs')} SELECT contig, 'M' AS kind, count(*) AS n_blocks, CAST(sum(least(pos + o + k, clen) - pos - o) AS BIGINT) AS bases, CAST(sum((pos + o) * 7 + q) AS BIGINT) AS checksum FROM segs GROUP BY contig
          UNION ALL SELECT contig, 'I', count(*), 0, CAST(sum((pos + 20) * 7 + 20) AS BIGINT) FROM al WHERE {USED} AND ln % 5 = 2 AND pos + 20 < clen GROUP BY contig""",
        "base_quality": f"""{_with('segs')}, b AS (SELECT contig, quals[q + j + 1] AS x FROM (SELECT contig, quals, q, unnest(range(0, least(pos + o + k, clen) - pos - o)) AS j FROM segs)),
          i AS (SELECT unnest(quals[21:22]) AS x FROM al WHERE {USED} AND ln % 5 = 2 AND pos + 20 < clen), a AS (SELECT x FROM b UNION ALL SELECT x FROM i)
          SELECT contig, count(*) FILTER (x >= 20) AS bases, (SELECT count(*) FROM a WHERE x >= 20) AS q20_bases, (SELECT count(*) FROM a WHERE x >= 30) AS q30_bases, (SELECT count(*) FROM a WHERE x >= 40) AS q40_bases FROM b GROUP BY contig""",
        "mate_overlap": f"""{_with('msegs')}, b AS ({overlap_bases}), u AS (SELECT contig, count(*) AS unique_bases FROM b WHERE {kept} GROUP BY contig)
          SELECT contig, CAST(sum(shared) AS BIGINT) AS overlap_bases, count(*) FILTER (inside) AS n_inside, count(*) FILTER (shared > 0) AS n_overlapping, max(u.unique_bases) AS unique_bases FROM mated LEFT JOIN u USING (contig) GROUP BY contig""",
        "read_target_class": f"{_with('bases', 'tpos', 'flank')}, cls AS ({CLASSES}) SELECT CAST(set_id AS BIGINT) AS set_id, count(*) FILTER (c = 2) AS on_target, count(*) FILTER (c = 1) AS in_buffer, count(*) FILTER (c = 0) AS off_target FROM cls GROUP BY set_id",
        "target_buffer_bases": f"{_with('flank')} SELECT t.set_id, count(DISTINCT (t.contig, t.interval_id)) AS n_targets, count(*) AS targeted_bases, (SELECT count(*) FROM flank f WHERE f.set_id = t.set_id) AS buffer_bases FROM tpos t GROUP BY t.set_id",
        "capture_summary": _capture_summary(),
        "capture_histogram": f"{_with('tdepth')} SELECT k.set_id, CAST(r.k AS BIGINT) AS depth, count(d.d) AS n_bases FROM (SELECT unnest(range(0, 1001)) AS k) r CROSS JOIN (SELECT DISTINCT set_id FROM targets) k LEFT JOIN tdepth d ON least(d.d, 1000) = r.k AND d.set_id = k.set_id GROUP BY ALL",
        "target_hits": f"""{_with('tdepth', used=low_hit)}, h AS (SELECT set_id, contig, interval_id, s0, max(d) > 0 AS hit FROM tdepth GROUP BY ALL)
          SELECT set_id, count(*) AS n_targets, count(*) FILTER (hit) AS n_hit, count(*) FILTER (NOT hit AND EXISTS (SELECT 1 FROM depth d WHERE d.contig = h.contig AND d.p >= h.s0 - 100 AND d.p < h.s0 AND d.d > 0)) AS n_buffer_only FROM h GROUP BY set_id""",
        "target_profile": f"""{_with('tdepth')}, b AS (SELECT set_id, contig, interval_id, CAST(floor((p - s0) * 100.0 / (e0 - s0) + 0.5) AS BIGINT) AS pct_bin, floor(avg(d) + 0.5) AS v FROM tdepth WHERE e0 - s0 >= 100 GROUP BY ALL)
          SELECT set_id, pct_bin, CAST(sum(v) AS BIGINT) AS value FROM b GROUP BY ALL""",
        "flank_profile": f"""{_with('depth', 'targets')}, j AS (SELECT set_id, CASE WHEN d.p < t.s0 THEN 'up' ELSE 'down' END AS side, CAST(CASE WHEN d.p < t.s0 THEN t.s0 - 1 - d.p ELSE d.p - t.e0 END AS BIGINT) AS distance, d.d FROM targets t JOIN depth d ON d.contig = t.contig AND (d.p >= t.s0 - 300 AND d.p < t.s0 OR d.p >= t.e0 AND d.p < t.e0 + 300) WHERE t.e0 - t.s0 >= 100 AND d.d > 0)
          SELECT set_id, side, distance, CAST(sum(d) AS BIGINT) AS sum_depth FROM j GROUP BY ALL""",
        "low_runs": f"{_with('tdepth')} SELECT set_id, contig, start_pos, end_pos, end_pos - start_pos AS length, {MEAN} AS mean_depth FROM ({_runs('(SELECT * FROM tdepth WHERE d < 20)', 'set_id, interval_id, contig', 'true', 'd')})",
        "wgs_low_runs": f"{_with('depth')} SELECT contig, start_pos, end_pos, end_pos - start_pos AS length, {MEAN} AS mean_depth FROM ({_runs('(SELECT * FROM depth WHERE d < 20)', 'contig', 'true', 'd')})",
        "high_runs": f"{_with('depth')} SELECT contig, start_pos, end_pos, end_pos - start_pos AS length, {MEAN} AS mean_depth FROM ({_runs('(SELECT * FROM depth WHERE d >= 60)', 'contig', 'true', 'd')})",
        "all_sites": f"{_with('tdepth')} SELECT set_id, contig, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, CAST(e0 - s0 AS BIGINT) AS length, CAST(floor(sum(d) * 1.0 / (e0 - s0) + 0.5) AS BIGINT) AS mean_depth FROM tdepth GROUP BY set_id, contig, interval_id, s0, e0",
        "downsample_counts": f"""{_with('al')} SELECT contig, count(*) AS reads FROM al
            WHERE CAST('0x' || substr(md5(qname || ':11'), 1, 7) AS BIGINT) < {(1 << 28) // 4} GROUP BY contig""",
        "off_target": f"{_with('depth', 'targets')}, {_off_target('targets', 30)} SELECT * FROM hot",
        "uniformity_blocks": f"{_with('depth')} SELECT contig, start_pos, end_pos, end_pos - start_pos AS length, CAST(cls AS BIGINT) AS class, {MEAN} AS mean_depth FROM ({_runs('depth', 'contig', CLASS30, 'd')})",
        "uniformity_gvcf": _gvcf("depth", 1, 10, 2),
        "uniformity_hist": f"""{_with('depth')}, b AS (SELECT least({MEAN}, 1000) AS m, end_pos - start_pos AS n FROM ({_runs('depth', 'contig', CLASS150, 'd')}) WHERE contig NOT IN ('chrX', 'chrY'))
          SELECT CAST(r.k AS BIGINT) AS depth, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_bases FROM (SELECT unnest(range(0, 1001)) AS k) r LEFT JOIN b ON b.m = r.k GROUP BY r.k""",
        "uniformity_metric": _metric(),
        "plot_points": f"""{_with('depth')}, b AS (SELECT contig, start_pos, end_pos, {MEAN} AS m FROM ({_runs('depth', 'contig', CLASS30, 'd')}) WHERE cls <> 0), g AS (SELECT *, lag(end_pos) OVER (PARTITION BY contig ORDER BY start_pos) AS prev FROM b)
          SELECT contig, start_pos AS pos, CASE WHEN m > 40 THEN 38 ELSE m END AS value FROM g UNION ALL SELECT contig, unnest(range(prev, start_pos, 100)) AS pos, 0 AS value FROM g WHERE prev < start_pos""",
        "mask_blocks": f"""{_with('depth')}, b AS (SELECT contig, start_pos, end_pos, {MEAN} AS m FROM ({_runs('depth', 'contig', CLASS30, 'd')})),
          x AS (SELECT b.contig, b.start_pos AS s, unnest(range(b.start_pos, b.end_pos)) AS p, m FROM b), y AS (SELECT x.*, p >= floor(c.length / 3) AND p < floor(c.length / 3) + 700 AS masked FROM x JOIN contigs c USING (contig))
          SELECT contig, start_pos, end_pos, end_pos - start_pos AS length, CASE WHEN cls THEN 0 ELSE m END AS mean_depth FROM ({_runs('y', 'contig, s, m', 'masked')})""",
        "interval_merge": f"{_with('spos')} SELECT sample_id, contig, start_pos, end_pos FROM ({_runs('spos', 'sample_id, contig', 'true')})",
        "interval_subtract": f"{_with('spos', 'tpos')}, r AS (SELECT DISTINCT s.contig, s.p FROM spos s ANTI JOIN (SELECT contig, p FROM tpos WHERE set_id = 0) t ON t.contig = s.contig AND t.p = s.p) SELECT contig, start_pos, end_pos FROM ({_runs('r', 'contig', 'true')})",
        "interval_intersect": f"{_with('sample_regions', 'targets')} SELECT s.sample_id, s.contig, CAST(greatest(s.s0, t.s0) AS BIGINT) AS start_pos, CAST(least(s.e0, t.e0) AS BIGINT) AS end_pos FROM sample_regions s JOIN targets t ON t.contig = s.contig AND t.set_id = 0 AND s.s0 < t.e0 AND t.s0 < s.e0",
        "interval_partition": f"{_with('cds')}, {PARTITION} SELECT contig, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, (SELECT count(*) FROM cds c WHERE c.contig = g.contig AND c.s0 <= g.s AND c.e0 >= g.e) AS depth FROM g WHERE EXISTS (SELECT 1 FROM cds c WHERE c.contig = g.contig AND c.s0 <= g.s AND c.e0 >= g.e)",
        "interval_map_ids": f"{_with('cds')}, {PARTITION} SELECT g.contig, CAST(g.s AS BIGINT) AS start_pos, CAST(g.e AS BIGINT) AS end_pos, array_to_string(list_sort(list_distinct(list(c.transcript))), ';') AS ids FROM g JOIN cds c ON c.contig = g.contig AND c.s0 <= g.s AND c.e0 >= g.e GROUP BY ALL",
        "interval_group_identical": f"{_with('cds')} SELECT contig, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, array_to_string(list_sort(list_distinct(list(transcript))), ';') AS ids FROM cds GROUP BY contig, s0, e0",
        "overlap_join": f"{_with('sample_regions', 'targets')} SELECT s.sample_id, s.contig, CAST(s.s0 AS BIGINT) AS start_pos, CAST(s.e0 AS BIGINT) AS end_pos, t.interval_id AS b_interval_id, CAST(CASE WHEN t.s0 IS NULL THEN 0 ELSE least(s.e0, t.e0) - greatest(s.s0, t.s0) END AS BIGINT) AS overlap FROM (SELECT DISTINCT * FROM sample_regions) s LEFT JOIN (SELECT * FROM targets WHERE set_id = 0) t ON t.contig = s.contig AND s.s0 < t.e0 AND t.s0 < s.e0",
        "multi_sample_depth": f"{_with('spos')}, m AS (SELECT contig, p, count(*) AS n FROM spos GROUP BY ALL) SELECT contig, start_pos, end_pos, cls AS n_samples FROM ({_runs('m', 'contig', 'n')})",
        "multi_sample_sets": f"""{_with('sample_regions')}, x AS (SELECT DISTINCT concat('s', sample_id, '-', s0 % 19) AS sample, contig, unnest(range(s0, e0)) AS p FROM sample_regions),
          m AS (SELECT contig, p, count(*) AS n, string_agg(sample, ';' ORDER BY sample) AS samples FROM x GROUP BY ALL)
          SELECT contig, start_pos, end_pos, n AS n_samples, samples FROM (SELECT contig, n, cls AS samples, start_pos, end_pos FROM ({_runs('m', 'contig, n', 'samples')}))""",
        "region_annotation": f"""{_with('spos', 'cds', 'gene_model')}, {regions}, x AS (SELECT m.contig, m.start_pos, m.end_pos, c.gene, c.type, concat(c.transcript, '_cds_', c.exon_id) AS label, CASE WHEN lower(c.type) = 'snp' THEN 'other' WHEN lower(c.type) = 'mirna' THEN 'mirna' ELSE 'refseq' END AS src FROM merged m JOIN cds c ON c.contig = m.contig AND m.start_pos < c.e0 AND c.s0 < m.end_pos),
          e AS (SELECT contig, start_pos, end_pos, 'exon' AS kind, string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes, string_agg(DISTINCT label, ';' ORDER BY label) FILTER (src = 'refseq') AS refseq, string_agg(DISTINCT label, ';' ORDER BY label) FILTER (src = 'mirna') AS mirna, string_agg(DISTINCT label, ';' ORDER BY label) FILTER (src = 'other') AS other FROM x GROUP BY ALL),
          i AS ({INTRONS}), f AS (SELECT DISTINCT ON (m.contig, m.start_pos, m.end_pos) m.contig, m.start_pos, m.end_pos, 'intron' AS kind, i.gene AS genes, i.name AS refseq FROM (SELECT * FROM merged ANTI JOIN e USING (contig, start_pos, end_pos)) m JOIN i ON i.contig = m.contig AND m.start_pos < i.end_pos AND i.start_pos < m.end_pos ORDER BY m.contig, m.start_pos, m.end_pos, i.start_pos, i.gene, i.name)
          SELECT m.contig, m.start_pos, m.end_pos, coalesce(e.kind, f.kind, 'intergenic') AS kind, coalesce(e.genes, f.genes) AS genes, CASE WHEN e.kind IS NULL THEN f.refseq ELSE e.refseq END AS refseq, CAST(NULL AS VARCHAR) AS ccds, CAST(NULL AS VARCHAR) AS vega, e.mirna, e.other FROM merged m LEFT JOIN e USING (contig, start_pos, end_pos) LEFT JOIN f USING (contig, start_pos, end_pos)""",
        "cds_pct": f"{_with('cds_rows')} SELECT contig, gene, transcript, CAST(exon_id AS BIGINT) AS exon_id, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, CAST(length AS BIGINT) AS length, CAST(low_bases AS BIGINT) AS low_bases, {CDS_PCT} AS pct, CASE WHEN exon_id < -1 THEN 'NOT_Designed' ELSE regions END AS low_regions FROM cds_rows",
        "cds_target_pct": f"""{_with('cds', 'targets', 'low')}, one AS (SELECT DISTINCT contig, gene, transcript, exon_id, s0, e0 FROM cds),
            area AS (SELECT DISTINCT contig, unnest(list_concat(range(s0, e0 + 5), range(s0 - 12, s0 - 4))) AS p FROM targets),
            base AS (SELECT o.*, a.p, l.p IS NOT NULL AS low FROM one o JOIN area a ON a.contig = o.contig AND a.p >= o.s0 AND a.p < o.e0 LEFT JOIN low l ON l.contig = a.contig AND l.p = a.p),
            sums AS (SELECT contig, gene, transcript, s0, e0, max(exon_id) AS exon_id, count(DISTINCT p) AS length, count(DISTINCT p) FILTER (low) AS low_bases FROM base GROUP BY ALL),
            spans AS (SELECT contig, gene, transcript, s0, e0, kind, min(p) AS a, max(p) + 1 AS b FROM (
              SELECT *, p - row_number() OVER (PARTITION BY contig, gene, transcript, s0, e0, kind ORDER BY p) AS g FROM (
                SELECT DISTINCT contig, gene, transcript, s0, e0, p, 'piece' AS kind FROM base UNION ALL SELECT DISTINCT contig, gene, transcript, s0, e0, p, 'low' FROM base WHERE low)) GROUP BY contig, gene, transcript, s0, e0, kind, g),
            texts AS (SELECT contig, gene, transcript, s0, e0, string_agg(concat(a, '-', b), ';' ORDER BY a) FILTER (kind = 'piece') AS pieces, string_agg(concat(a, '-', b), ';' ORDER BY a) FILTER (kind = 'low') AS regions FROM spans GROUP BY ALL)
            SELECT contig, gene, transcript, CASE WHEN exon_id = -1 THEN '_' ELSE concat('cds_', exon_id) END AS label, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, length,
              low_bases, {CDS_PCT} AS pct, CASE WHEN exon_id < -1 THEN 'NOT_Designed' ELSE regions END AS low_regions, pieces FROM sums JOIN texts USING (contig, gene, transcript, s0, e0)""",
        "transcript_pct": f"{_with('tx_rows')} SELECT contig, gene, transcript, CAST(length AS BIGINT) AS length, n_cds, pct FROM tx_rows",
        "gene_pct": f"{_with('tx_rows')} SELECT gene, count(*) AS n_transcripts, avg(pct) AS pct, string_agg(item, ';' ORDER BY item) AS transcripts FROM (SELECT *, concat(transcript, printf('(%.2f)', floor(pct * 100 + 0.5) / 100)) AS item FROM tx_rows) GROUP BY gene",
        "preferred_gene_pct": f"{_with('tx_rows')} SELECT gene, count(*) AS n_transcripts, avg(pct) AS pct FROM tx_rows x WHERE transcript LIKE 'NR%' OR NOT EXISTS (SELECT 1 FROM tx_rows y WHERE y.gene = x.gene AND y.transcript LIKE 'NR%') GROUP BY gene",
        "coverage_categories": f"""{_with('tx_rows')}, l AS (SELECT 'exon' AS level, {CDS_PCT} AS pct FROM cds_rows WHERE length % 7 <> 0 UNION ALL SELECT 'transcript', pct FROM tx_rows WHERE length % 7 <> 0 UNION ALL SELECT 'gene', avg(pct) FROM tx_rows GROUP BY gene),
          c AS (SELECT level, CASE WHEN pct >= 100 THEN '100' WHEN pct >= 97 THEN '>=97' WHEN pct >= 90 THEN '>=90' ELSE '<90' END AS category, count(*) AS n FROM l GROUP BY ALL) SELECT level, category, n, {_pct('n', '(sum(n) OVER (PARTITION BY level))')} AS share FROM c""",
        "batch_recurrence": f"{_with('often')} SELECT contig, start_pos, end_pos FROM ({_runs('often', 'contig', 'true')})",
        "batch_exon_pct": f"{_with('bex')} SELECT contig, gene, transcript, CAST(exon_id AS BIGINT) AS exon_id, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, CAST(length AS BIGINT) AS length, CAST(low_bases AS BIGINT) AS low_bases, CAST((length - low_bases) * 100.0 AS DOUBLE) / length AS pct FROM bex",
        "batch_transcript_pct": f"{_with('btx')} SELECT contig, gene, transcript, CAST(length AS BIGINT) AS length, n_exons, pct FROM btx",
        "batch_gene_pct": f"{_with('btx')} SELECT gene, count(*) AS n_transcripts, avg(pct) AS pct FROM btx WHERE gene <> 'Brand#11' GROUP BY gene",
        "exon_explode": f"""{_with('exons')}, x AS (SELECT *, cds_start < cds_end AS coding FROM exons), y AS (SELECT *, CASE WHEN coding THEN cds_start ELSE tx_start END AS c0, CASE WHEN coding THEN cds_end ELSE tx_end END AS c1, row_number() OVER () AS r FROM x)
          SELECT name, contig, strand, coding, CAST(CASE WHEN strand = '-' THEN exon_count - k - 1 ELSE k END AS BIGINT) AS exon_id, CAST(s0 AS BIGINT) AS start_pos, CAST(e0 AS BIGINT) AS end_pos, CAST(sum(greatest(least(e0, c1) - greatest(s0, c0), 0)) OVER (PARTITION BY name, contig, tx_start, tx_end, symbol) AS BIGINT) AS cds_length FROM y""",
        "cds_coords": f"""{_with('exons', 'ids')}, k AS (SELECT id, min(symbol) AS known FROM ids GROUP BY id), x AS (SELECT *, sum(greatest(least(e0, cds_end) - greatest(s0, cds_start), 0)) OVER (PARTITION BY name, contig, tx_start, tx_end, symbol) AS len FROM exons WHERE cds_start < cds_end)
          SELECT substr(contig, 4) AS contig, CAST(greatest(s0, cds_start) AS BIGINT) AS cds_start, CAST(least(e0, cds_end) AS BIGINT) AS cds_end, coalesce(x.symbol, k.known, '.') AS gene, name AS transcript, CAST(CASE WHEN strand = '-' THEN exon_count - x.k - 1 ELSE x.k END AS BIGINT) AS exon_id, CAST(len AS BIGINT) AS length FROM x LEFT JOIN k ON k.id = x.name WHERE e0 > cds_start AND s0 < cds_end""",
        "introns": f"{_with('gene_model')} SELECT name, contig, gene, intron_id, start_pos, end_pos FROM ({INTRONS})",
        "registry_lookup": f"{_with('gene_model', 'known')} SELECT g.name, g.contig, CAST(g.tx_start AS BIGINT) AS tx_start, k.symbol AS hgnc_symbol, k.prev AS hgnc_prev FROM gene_model g LEFT JOIN known k ON k.id = g.name",
        "unique_names": f"{_with('gene_model')} SELECT CASE WHEN r > 1 THEN concat(name, '-', r - 1) ELSE name END AS name, contig, CAST(tx_start AS BIGINT) AS tx_start FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY contig, tx_start, tx_end) AS r FROM gene_model)",
        "exon_table": _table(EXON_ROWS, False),
        "intron_table": _table(INTRON_ROWS, True),
        "annotated_contigs": f"{_with('cds')} SELECT contig, count(*) AS n FROM cds GROUP BY contig",
        "overlap_report": f"""{_with('msegs', 'counts')}, b AS ({overlap_bases}), f AS (SELECT (SELECT count(*) FROM b WHERE {kept}) AS unique_bases, (SELECT sum(shared) FROM mated) AS shared, mapped_bases FROM counts)
          {_union([("Total_Mapped_Bases", "mapped_bases"), ("Total_Uniquely_Aligned_Bases", "unique_bases"), ("Total_Overlapped_Aligned_Bases", "shared"), ("PCT_Overlapped_Aligned_Bases", _pct("shared", "mapped_bases"))], "f")}""",
        "validate_intervals": f"""{_with('sample_regions')}, r AS (SELECT *, row_number() OVER () AS id FROM sample_regions), u AS (SELECT DISTINCT a.id, a.contig, a.s0 FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.contig = b.contig AND b.e0 >= a.s0 AND (b.s0 < a.s0 OR b.s0 = a.s0 AND (b.e0 < a.e0 OR b.e0 = a.e0 AND b.id < a.id)))
          SELECT 'unmerged' AS problem, contig, count(*) AS n, CAST(sum(s0) AS BIGINT) AS sum_start FROM u GROUP BY contig UNION ALL SELECT 'contig_name', contig, count(*), CAST(sum(s0) AS BIGINT) FROM r GROUP BY contig""",
        "depth_lines": f"{_with('depth')} SELECT contig, CAST(floor(p / 100.0) AS BIGINT) AS line, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY p) AS text FROM depth GROUP BY contig, floor(p / 100.0)",
    }
    sql |= {f"cohort_{name}": _cohort(sql[name]) for name in ("wgs_summary", "capture_summary", "uniformity_metric", "gene_pct")}
    return sql | _files()


PARTITION = "pts AS (SELECT DISTINCT contig, unnest([s0, e0]) AS s FROM cds), g AS (SELECT contig, s, lead(s) OVER (PARTITION BY contig ORDER BY s) AS e FROM pts)"
INTRONS = "SELECT name, contig, coalesce(symbol, '.') AS gene, CAST(j AS BIGINT) AS intron_id, CAST(exon_ends[j] AS BIGINT) AS start_pos, CAST(exon_starts[j + 1] AS BIGINT) AS end_pos FROM (SELECT *, unnest(range(1, exon_count)) AS j FROM gene_model)"


def _table(rows: str, introns: bool) -> str:
    """Segments between all starts and ends of rows (and of exons, for introns) that rows cover and, for introns, exons don't."""
    more, outside = ("UNION ALL SELECT contig, s0, e0 FROM mexons", "AND NOT EXISTS (SELECT 1 FROM mexons x WHERE x.contig = g.contig AND x.s0 < g.e AND g.s < x.e0)") if introns else ("", "")
    column = "CASE WHEN kind = 'refseq' THEN 'refseq' WHEN kind = 'ccds' THEN 'ccds' WHEN kind = 'mirbase' THEN 'mirna' WHEN kind IS NULL THEN 'other' ELSE 'vega' END"
    kinds = ", ".join(f"string_agg(DISTINCT label, ';' ORDER BY label) FILTER (col = '{k}') AS {k}" for k in ("refseq", "ccds", "vega", "mirna", "other"))
    return f"""{_with('mexons', 'mintrons', 'lists', 'typed')}, rows AS ({rows}), pts AS (SELECT DISTINCT contig, unnest([s0, e0]) AS s FROM (SELECT contig, s0, e0 FROM rows {more})),
      g AS (SELECT contig, s, lead(s) OVER (PARTITION BY contig ORDER BY s) AS e FROM pts),
      hit AS (SELECT g.contig, g.s, g.e, r.name, r.symbol, r.label, t.kind, t.id, {column} AS col FROM g JOIN rows r ON r.contig = g.contig AND r.s0 <= g.s AND r.e0 >= g.e JOIN typed t ON t.name = r.name WHERE true {outside}),
      sym AS (SELECT contig, s, e, symbol AS x FROM hit UNION SELECT h.contig, h.s, h.e, l.symbol FROM hit h JOIN lists l ON l.kind = h.kind AND l.id = h.id),
      syms AS (SELECT contig, s, e, list_sort(list(x)) AS xs FROM sym WHERE x <> '.' AND x <> '' GROUP BY ALL),
      prv AS (SELECT DISTINCT h.contig, h.s, h.e, l.prev AS x FROM hit h JOIN lists l ON l.kind = h.kind AND l.id = h.id WHERE l.prev IS NOT NULL),
      prvs AS (SELECT p.contig, p.s, p.e, string_agg(p.x, ';' ORDER BY p.x) AS prev FROM prv p LEFT JOIN syms y ON y.contig = p.contig AND y.s = p.s AND y.e = p.e {"WHERE NOT list_contains(coalesce(y.xs, []), p.x)" if introns else ""} GROUP BY ALL),
      base AS (SELECT contig, s, e, {kinds} FROM hit GROUP BY contig, s, e)
      SELECT b.contig, CAST(b.s AS BIGINT) AS start_pos, CAST(b.e AS BIGINT) AS end_pos, y.xs[1] AS symbol, CASE WHEN len(y.xs) > 1 THEN array_to_string(y.xs[2:], ';') END AS synonyms, p.prev, b.refseq, b.ccds, b.vega, b.mirna, b.other
      FROM base b LEFT JOIN syms y ON y.contig = b.contig AND y.s = b.s AND y.e = b.e LEFT JOIN prvs p ON p.contig = b.contig AND p.s = b.s AND p.e = b.e"""


EXON_ROWS = "SELECT contig, concat(name, '|exon_', exon_id, '|gene') AS label, name, symbol, s0, e0 FROM mexons"
INTRON_ROWS = "SELECT contig, concat(name, '|intron_', intron_id, '|gene') AS label, name, symbol, s0, e0 FROM mintrons"


def _split(lower: int, upper: int, factor: float) -> str:
    """The greedy split base by base, as a recursive query over all contigs at once."""
    return f"""walk AS (SELECT contig, p, d, CASE WHEN d < {lower} THEN 0 WHEN d <= {upper} THEN 1 ELSE 2 END AS cls, d AS lo, d AS hi, CAST(0 AS BIGINT) AS b FROM depth WHERE p = 0
      UNION ALL SELECT n.contig, n.p, n.d, n.cls, CASE WHEN n.same THEN least(n.lo, n.d) ELSE n.d END, CASE WHEN n.same THEN greatest(n.hi, n.d) ELSE n.d END, CASE WHEN n.same THEN n.b ELSE n.b + 1 END
      FROM (SELECT x.contig, x.p, x.d, x.cls, w.lo, w.hi, w.b, x.cls = w.cls AND (x.cls < 2 OR greatest(w.hi, x.d) <= least(w.lo, x.d) * {factor}) AS same
        FROM walk w JOIN (SELECT *, CASE WHEN d < {lower} THEN 0 WHEN d <= {upper} THEN 1 ELSE 2 END AS cls FROM depth) x ON x.contig = w.contig AND x.p = w.p + 1) n)"""


def _recursive(with_clause: str) -> str:
    return with_clause.replace("WITH ", "WITH RECURSIVE ", 1).replace("\ndepth AS (", "\ndepth AS MATERIALIZED (")


def _gvcf(depth: str, lower: int, upper: int, factor: float) -> str:
    return f"""{_recursive(_with(depth))}, {_split(lower, upper, factor)}
      SELECT contig, CAST(min(p) AS BIGINT) AS start_pos, CAST(max(p) + 1 AS BIGINT) AS end_pos, CAST(count(*) AS BIGINT) AS length, CAST(cls AS BIGINT) AS class, CAST(floor(sum(d) * 1.0 / count(*) + 0.5) AS BIGINT) AS mean_depth FROM walk GROUP BY contig, b, cls"""


def _metric() -> str:
    k = "CASE WHEN m <= 20 THEN 3 WHEN m <= 25 THEN 4 WHEN m <= 30 THEN 5 WHEN m <= 35 THEN 6 WHEN m <= 55 THEN 7 WHEN m <= 70 THEN 8 WHEN m <= 85 THEN 9 WHEN m <= 100 THEN 10 WHEN m <= 110 THEN 11 WHEN m <= 120 THEN 12 ELSE 13 END"
    return f"""{_recursive(_with('depth'))}, {_split(1, 150, 10)},
      blk AS (SELECT contig, least(floor(sum(d) * 1.0 / count(*) + 0.5), 1000) AS m, count(*) AS n FROM walk WHERE contig NOT IN ('chrX', 'chrY') GROUP BY contig, b),
      h AS (SELECT r.k AS x, coalesce(sum(blk.n), 0) AS n FROM (SELECT unnest(range(0, 1001)) AS k) r LEFT JOIN blk ON blk.m = r.k GROUP BY r.k),
      facts AS (SELECT {k} AS k, (SELECT x FROM h WHERE x > 0 ORDER BY n DESC, x LIMIT 1) AS mode FROM (SELECT (SELECT sum(d) FROM depth) / {GENOME} AS m)),
      area AS (SELECT mode, k, mode - 1 AS l, mode + 1 AS r, 1 AS c, (SELECT n FROM h WHERE x = mode) AS s FROM facts
        UNION ALL SELECT mode, k, l - CASE WHEN a > b OR a = b AND k - c >= 2 THEN 1 ELSE 0 END, r + CASE WHEN b >= a THEN 1 ELSE 0 END, c + CASE WHEN a = b AND k - c >= 2 THEN 2 ELSE 1 END,
          s + CASE WHEN a > b THEN a WHEN b > a THEN b WHEN k - c >= 2 THEN 2 * b ELSE b END
        FROM (SELECT t.*, CASE WHEN t.l > 0 THEN coalesce(hl.n, 0) ELSE 0 END AS a, coalesce(hr.n, 0) AS b FROM area t LEFT JOIN h hl ON hl.x = t.l LEFT JOIN h hr ON hr.x = t.r) WHERE c < k AND (a > 0 OR b > 0))
      SELECT CAST(mode AS BIGINT) AS mode, CAST(max(s) AS BIGINT) AS peak_area, CAST(t AS BIGINT) AS total_area, CAST(max(s) AS DOUBLE) / t AS uniformity
      FROM area, (SELECT (SELECT sum(n) FROM h) - {NS} + (SELECT count(*) FROM in_n WHERE contig IN ('chrX', 'chrY')) AS t) GROUP BY mode, t"""
