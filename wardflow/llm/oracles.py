"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

CHECKS: dict[str, str] = {}

CHECKS["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents
), sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(content, '[^\x20\x09-\x0D]+'))) AS w
  FROM lines WHERE regexp_matches(content, '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT w, len(w) AS n, min((doc_id, line)) AS first, row_number() OVER () AS id FROM sets GROUP BY w
), words AS (
  SELECT id, n, unnest(w) AS t FROM firsts
), rarity AS (
  SELECT t, row_number() OVER (ORDER BY count(*), t) AS r FROM words GROUP BY t
), heads AS (
  SELECT id, n, r FROM (SELECT id, n, r, row_number() OVER (PARTITION BY id ORDER BY r) AS p FROM words JOIN rarity USING (t))
  WHERE p <= n - ceil(n * 4 / 5) + 1
), pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.r = b.r AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), hits AS (
  SELECT DISTINCT b AS id FROM pairs JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b
  WHERE x.first < y.first AND 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)
), verdicts AS (
  SELECT s.doc_id, s.line, f.first < (s.doc_id, s.line) OR h.id IS NOT NULL AS gone
  FROM sets s JOIN firsts f ON s.w = f.w LEFT JOIN hits h ON h.id = f.id
), texts AS (
  SELECT l.doc_id, count(v.line) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(content, chr(10) ORDER BY l.line) FILTER (gone IS DISTINCT FROM true), '') AS kept
  FROM lines l LEFT JOIN verdicts v ON v.doc_id = l.doc_id AND v.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM texts
"""

CHECKS["op6_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * words AS cap, row_number() OVER (ORDER BY 3.0 * words / weight, source NULLS LAST) AS place FROM sources
), levels AS (
  -- with the first place-1 sources at their cap, the level that deals out the rest
  SELECT *, (sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
            / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM ranked
), chosen AS (
  SELECT coalesce((SELECT level FROM levels WHERE level * weight < cap ORDER BY place LIMIT 1), 0) AS level
), targets AS (
  SELECT source, words, least(cap::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM ranked
), placed AS (
  SELECT doc_id, s.source, size,
         (sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM sized s
)
SELECT doc_id, size, words AS source_size, target,
       (CASE WHEN words > 0 THEN (round(target)::BIGINT // words) * size
             + least(greatest(round(target)::BIGINT % words - before, 0), size) ELSE 0 END)::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

CHECKS["op8_pivot_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

CHECKS["op9_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS follows
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN follows THEN 6 ELSE 12 + length(role) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

CHECKS["op13_source_divergence"] = r"""
WITH rows AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), terms AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM rows
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, coalesce(sum(n), 0)::HUGEINT AS total, count(n)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM rows) LEFT JOIN kept USING (lang) GROUP BY lang
), sources AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
         1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), marks AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C")::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
