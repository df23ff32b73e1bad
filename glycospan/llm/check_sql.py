"""DuckDB SQL for the queries of the text operators that SQL can state, written from their definitions."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str = _SPACED) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


QUALITY_RULES = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - kinds, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
         len(list_distinct(w)) AS n_distinct
  FROM texts t LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
measured AS (
  SELECT doc_id, lang, source, unnest([
    {{'metric': 'symbols', 'side': 'high', 'gap': 150, 'v': 1000 * n_symbols // n_words}},
    {{'metric': 'dup_lines', 'side': 'high', 'gap': 350, 'v': 1000 * n_dup_lines // n_lines}},
    {{'metric': 'repeats', 'side': 'high', 'gap': 280, 'v': 1000 * n_repeat_words // n_words}},
    {{'metric': 'word_length', 'side': 'both', 'gap': 4000, 'v': 1000 * word_chars // n_words}},
    {{'metric': 'capitals', 'side': 'high', 'gap': 400, 'v': 1000 * n_upper // greatest(word_chars, 1)}},
    {{'metric': 'variety', 'side': 'low', 'gap': 400, 'v': 1000 * n_distinct // n_words}}], recursive := true)
  FROM counts WHERE n_words > 0),
-- a value keeps its seven leading binary digits
kept_digits AS (
  SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS d FROM measured),
ranked AS (
  SELECT * FROM (
    SELECT 1 AS level, lang, source, metric, d,
           row_number() OVER (PARTITION BY lang, source, metric ORDER BY d) AS place,
           count(*) OVER (PARTITION BY lang, source, metric) AS docs FROM kept_digits
    UNION ALL
    SELECT 2, lang, NULL, metric, d, row_number() OVER (PARTITION BY lang, metric ORDER BY d),
           count(*) OVER (PARTITION BY lang, metric) FROM kept_digits
    UNION ALL
    SELECT 3, NULL, NULL, metric, d, row_number() OVER (PARTITION BY metric ORDER BY d),
           count(*) OVER (PARTITION BY metric) FROM kept_digits)),
quantiles AS (
  SELECT level, lang, source, metric, docs,
         min(d) FILTER (WHERE place >= ceil(docs * 0.1::DOUBLE)) AS q10,
         min(d) FILTER (WHERE place >= ceil(docs * 0.5::DOUBLE)) AS q50,
         min(d) FILTER (WHERE place >= ceil(docs * 0.9::DOUBLE)) AS q90
  FROM ranked GROUP BY ALL),
odd AS (
  SELECT DISTINCT m.doc_id
  FROM measured m JOIN quantiles q ON q.metric = m.metric AND (
         q.level = 1 AND q.lang IS NOT DISTINCT FROM m.lang AND q.source IS NOT DISTINCT FROM m.source
      OR q.level = 2 AND q.lang IS NOT DISTINCT FROM m.lang OR q.level = 3)
  WHERE q.docs >= 100 OR q.level = 3
  QUALIFY q.level = min(q.level) OVER (PARTITION BY m.doc_id, m.metric)
     AND (m.side <> 'low' AND m.v > q.q50 + greatest(3 * (q.q90 - q.q50), m.gap)
       OR m.side <> 'high' AND m.v < q.q50 - greatest(3 * (q.q50 - q.q10), m.gap)))
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND o.doc_id IS NULL AS kept
FROM counts c LEFT JOIN odd o USING (doc_id)
"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words(_LOWER.format("text"), _PLAIN)} AS w FROM documents),
items AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM (
    SELECT item_id, {_words(_LOWER.format("text"), _PLAIN)} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, size, list_slice(w, i, i + size - 1) AS gram
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
starts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM docs, (SELECT DISTINCT size FROM items)),
hits AS (
  SELECT doc_id, i, s.size, item_id
  FROM (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS gram FROM starts) s
  JOIN grams g ON g.size = s.size AND g.gram = s.gram),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte, substr(h, 2 * i - 1, 200) AS gram
          FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM docs)),
keyed AS (SELECT doc_id, i, byte, CASE WHEN length(gram) = 200 THEN md5_number(gram) END AS k FROM bytes),
starts AS (
  SELECT doc_id, i, byte,
         k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM keyed),
judged AS (
  SELECT doc_id, i, byte, coalesce(bool_or(later) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone
  FROM starts),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM judged),
sums AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM edges GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 49)) AS h1, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h2
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h1, h2) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM later),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_LOWER.format("text"))} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 2)) AS h, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

HARD_NEGATIVES = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
       row_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

SQL = {
    "op2_quality_rules": QUALITY_RULES,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op6_decontamination": DECONTAMINATION,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op8_jaccard_join": JACCARD_JOIN,
    "op12_hard_negatives": HARD_NEGATIVES,
}
