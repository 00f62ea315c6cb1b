"""The queries opN_<name> and the SQL that expresses some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fuzzy_hash, html_text, line_dedup, ngram_join, packing, pii, prefix_trie, quality, sharding, spelling, suffix_dedup
from .storage import documents

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_hash.fingerprints_with_edits(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, how many went, and the digest of what is left."""
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the rebuilt conversations: the first turns of each come from that with the next lower number that 5 divides."""
    conv = F.col("conv_id").cast("bigint")
    paths = prefix_trie.conversation_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 5, prefix_trie.shared_turns)
    return prefix_trie.trie(paths).drop("digest")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_sharding, op4_pii, op5_html_text, op6_fuzzy_hash, op7_decontamination, op8_suffix_dedup, op9_line_dedup, op10_quality, op11_exact_dedup, op12_prefix_trie, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": NGRAM_SQL, "op3_sharding": _sharding_sql(), "op8_suffix_dedup": REPEATS_SQL, "op9_line_dedup": LINE_SQL, "op11_exact_dedup": EXACT_SQL, "op12_prefix_trie": TRIE_SQL, "op13_spelling_variants": SPELLING_SQL}


def _sharding_sql() -> str:
    table = sharding.fill_table(SHARDS)
    return f"""
WITH placed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {len(table)} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(list_extract({table}, slot + 1) AS VARCHAR), 3, '0') AS shard FROM placed"""


NGRAM_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""

LINE_SQL = """
WITH parts AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, no, lines[no + 1] AS line, doc_id * 10000000 + no AS place FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS no FROM parts)),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''))) AS t FROM l),
s AS (SELECT t, min(place) AS place, len(t) AS n FROM w WHERE len(t) >= 1 GROUP BY t),
tok AS (SELECT place, n, unnest(t) AS tok FROM s),
freq AS (SELECT tok, count(*) AS f FROM tok GROUP BY tok),
ranked AS (SELECT place, n, tok, row_number() OVER (PARTITION BY place ORDER BY f, tok) AS r FROM tok JOIN freq USING (tok)),
prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(n * 0.8) + 1),
cand AS (SELECT DISTINCT a.place AS a, b.place AS b FROM prefix a JOIN prefix b ON a.tok = b.tok AND a.place < b.place AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
later AS (SELECT DISTINCT b AS place FROM cand JOIN s x ON x.place = a JOIN s y ON y.place = b WHERE 10 * len(list_intersect(x.t, y.t)) >= 8 * (x.n + y.n - len(list_intersect(x.t, y.t)))),
gone AS (SELECT w.place FROM w JOIN s ON s.t = w.t WHERE w.place > s.place OR s.place IN (SELECT place FROM later))
SELECT w.doc_id, count(*) FILTER (p.text IS NOT NULL) AS n_lines, count(g.place) AS n_removed, sha256(coalesce(string_agg(w.line, chr(10) ORDER BY w.no) FILTER (g.place IS NULL), '')) AS kept_sha256
FROM w JOIN parts p ON p.doc_id = w.doc_id LEFT JOIN gone g ON g.place = w.place GROUP BY w.doc_id"""

REPEATS_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, doc_id * 1000000000 + i AS place, substr(x, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(0, n - 99)) AS i FROM h)),
firsts AS (SELECT s, min(place) AS f FROM win GROUP BY s),
dup AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE place > f),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans),
kept AS (SELECT h.doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) || substr(any_value(x), 2 * max(high) + 1) AS x FROM gaps JOIN h ON h.doc_id = gaps.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept k ON k.doc_id = h.doc_id"""

EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, min(r) AS r, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.r = g.r AS kept, d.text_sha256 FROM d JOIN g ON g.text_sha256 = d.text_sha256"""

#: crc32 of a list of bytes, in SQL: the table of the reversed polynomial by its rule, then a byte at a time.
CRC_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text's bytes; `t` of crc_table must be in reach."""
    bytes_ = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)])), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
summed AS (SELECT w, n, {crc32_sql("doc_id || ':' || w")} AS h FROM own, crc_table),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON b.word = a.d
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON b.word = a.d),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN best ON best.a = w.word),
named AS (SELECT f.word, f.n, f.n_near, f.form_n, min(p.b) AS form FROM forms f LEFT JOIN pairs p ON p.a = f.word AND p.n = f.form_n GROUP BY ALL),
chain AS (SELECT word, word AS root FROM named UNION ALL SELECT c.word, x.form FROM chain c JOIN named x ON x.word = c.root WHERE x.form IS NOT NULL)
SELECT n.word, n.form, c.root, n.n, n.n_near, n.form_n FROM named n JOIN chain c ON c.word = n.word JOIN named z ON z.word = c.root AND z.form IS NULL"""

TRIE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM o),
hs AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM ids, crc_table),
rebuilt AS (
  SELECT hs.conv_id, k, role, text FROM hs JOIN o ON o.conv_id = hs.conv_id - hs.conv_id % 5 AND o.k < h
  UNION ALL SELECT hs.conv_id, k, role, text FROM hs JOIN o ON o.conv_id = hs.conv_id AND o.k >= h),
occ AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path, CAST(strlen(text) AS BIGINT) AS size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM occ GROUP BY d, path),
spot AS (SELECT occ.conv_id AS member, occ.d, node.conv_id FROM occ JOIN node ON node.d = occ.d AND node.path = occ.path),
full_ AS (SELECT n.conv_id, n.d, n.n_convs, n.size, a.conv_id AS parent FROM node n LEFT JOIN spot a ON a.member = n.conv_id AND a.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM full_ WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT a.conv_id, a.d, CAST(sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.size) AS BIGINT) AS saved
  FROM full_ f JOIN spot a ON a.member = f.conv_id AND a.d <= f.d LEFT JOIN kids k ON k.conv_id = f.conv_id AND k.d = f.d GROUP BY 1, 2),
lasts AS (SELECT conv_id AS member, max(d) AS d FROM occ GROUP BY conv_id),
ends AS (SELECT a.conv_id, a.d, string_agg(CAST(a.member AS VARCHAR), ',' ORDER BY a.member) AS ids FROM spot a JOIN lasts l ON l.member = a.member AND l.d = a.d GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_ f JOIN sums s ON s.conv_id = f.conv_id AND s.d = f.d LEFT JOIN kids k ON k.conv_id = f.conv_id AND k.d = f.d LEFT JOIN ends e ON e.conv_id = f.conv_id AND e.d = f.d"""
