"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import repair_conversations
from .embedding_dedup import embedding_near_dedup
from .kneser_ney import quality_scores, trusted_ids
from .line_dedup import line_dedup
from .matroska import media_digest
from .minhash import near_duplicates
from .mixing import poisson_mix
from .pseudo_likelihood import pseudo_likelihood
from .secret_scan import secret_digest
from .sentencepiece_viterbi import token_digest
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import toxicity

MIX_SEED = "mix-1"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").cast("long").alias("n_intervals"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), min_sites=5).select("doc_id", "n_lines", "n_cut", "text")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, every source brought to the same share; the whole rows, each as often as drawn."""
    mixed = poisson_mix(table(spark, sf_dir, "documents"), seed=MIX_SEED)
    return mixed.select("doc_id", "source", "lang", "n_chars", F.col("mix_copy").cast("long").alias("mix_copy"), "text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_matroska": op6_matroska,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

#: crc32 of a text's bytes: a table of 256 remainders, then a byte at a time. DuckDB has no such function.
CRC32 = """
bit AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS r FROM range(256) t(i)),
crc_table AS (SELECT list(r ORDER BY i) AS crcs FROM bit)"""


def crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text, for a query with CRC32 and one row of crc_table joined."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], {byte}), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)))"


ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH split AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS i, lines FROM split),
line AS (
  SELECT doc_id, source, i, lines[i] AS line, trim(regexp_replace(lines[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS same FROM each),
wide AS (SELECT same FROM line WHERE same <> '' GROUP BY same HAVING count(DISTINCT source) >= 5),
marked AS (SELECT l.*, w.same IS NOT NULL AS cut FROM line l LEFT JOIN wide w ON l.same = w.same),
made AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_cut, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut) AS kept
  FROM marked GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_cut, CASE WHEN n_cut > 0 THEN coalesce(kept, '') ELSE s.text END AS text
FROM split s JOIN made USING (doc_id)
""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM least m
""",
    "op10_poisson_mix": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM n) * (SELECT sum(n_rows)::DOUBLE FROM n) / n_rows AS rate FROM n),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
tables AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, len([c FOR c IN t.cdfs IF c <= ('0x' || substr(md5('{MIX_SEED}:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE]) AS copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, lang, n_chars, unnest(range(copies)) AS mix_copy, text FROM drawn
""",
    "op11_spelling_variants": f"""
WITH RECURSIVE {CRC32},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per, crc_table),
whole AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM whole WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, range(1, 1000000) t(p) WHERE p <= length(word)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, {{'n': -n, 'w': other}}) AS other, max(n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, CASE WHEN other_n >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON way.next = f.word)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON f.word = way.word AND way.next IS NULL
""",
    "op12_conversation_repair": f"""
WITH RECURSIVE {CRC32},
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations, crc_table),
after AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN how = 0 THEN 0 WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM after),
turns AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id),
runs(q, run, mid, lines) AS (
  VALUES ('-', '', '-', []::VARCHAR[]), ('s', '', 's', []), ('u', '', 'u', []), ('a', '', 'a', []),
    ('-', 'I', 'u', ['user:']), ('s', 'I', 'u', ['user:']), ('u', 'I', 'a', ['assistant:']), ('a', 'I', 'u', ['user:']),
    ('-', 'II', 'a', ['user:', 'assistant:']), ('s', 'II', 'a', ['user:', 'assistant:']), ('u', 'II', 'u', ['assistant:', 'user:']), ('a', 'II', 'a', ['user:', 'assistant:'])),
edits(edit, mid, initial, q, base) AS (
  VALUES ('D', '-', NULL, '-', 2), ('D', 's', NULL, 's', 2), ('D', 'u', NULL, 'u', 2), ('D', 'a', NULL, 'a', 2), ('R', '-', NULL, 'u', 1), ('R', 's', NULL, 'u', 1), ('R', 'u', NULL, 'a', 1), ('R', 'a', NULL, 'u', 1),
    ('K', '-', 's', 's', 0), ('K', '-', 'u', 'u', 0), ('K', 's', 'u', 'u', 0), ('K', 'a', 'u', 'u', 0), ('K', 'u', 'a', 'a', 0)),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, t.i, e.q, min({{'cost': (w.cost + 5 * length(r.run) + e.base + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'audit': w.audit || r.run || e.edit,
      'lines': w.lines || r.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE e.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text] END}}) AS best
    FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN runs r ON r.q = w.q
    JOIN edits e ON e.mid = r.mid AND (e.edit <> 'K' OR e.initial = t.initial) AND (e.edit = 'D' OR t.fault IS NULL OR t.fault = 'truncated')
    GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({{'cost': (w.cost + 5 * length(r.run))::BIGINT, 'audit': w.audit || r.run, 'lines': w.lines || r.lines}}) AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN runs r ON r.q = w.q AND (r.mid = 'a' OR w.q = '-' AND r.run = '') GROUP BY ALL)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
}
