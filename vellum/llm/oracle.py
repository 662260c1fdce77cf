"""DuckDB SQL for those queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), ends AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, md5(t) AS content, row_number() OVER () AS r, line,
    regexp_replace(trim(lower(line), E' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM docs)
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id
), frequent AS (
  SELECT host, norm FROM lines WHERE n > 0 GROUP BY host, norm HAVING count(DISTINCT content) > 10
), lost AS (
  SELECT doc_id, sum(n) AS n FROM lines l SEMI JOIN frequent f ON f.host = l.host AND f.norm = l.norm WHERE n > 0 GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(len(w) - coalesce(o.n, 0) AS BIGINT) AS n_left
  FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN dup u USING (doc_id) LEFT JOIN lost o USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_left < 0.5 * n_words AS kept
FROM base
"""

SQL = {"op6_line_frequency": OP6, "op5_jaccard_join": OP5}
