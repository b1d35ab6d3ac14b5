"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS ratio,
         sum(source_size) OVER () AS total
  FROM sources),
judged AS (
  SELECT a.source, a.source_size, a.weight, a.cap, a.total,
         (SELECT sum(CASE WHEN b.ratio <= a.ratio THEN b.cap ELSE a.ratio * b.weight END)
          FROM steps b) < a.total AS stops
  FROM steps a),
level AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (WHERE stops), 0))::DOUBLE
         / sum(weight) FILTER (WHERE NOT stops) AS height
  FROM judged),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(height, 0)) AS target
  FROM judged, level),
rates AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
         / 4294967296.0 AS coin
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT
                + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""


_SUBSTRINGS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM split),
windows AS (
  SELECT doc_id, unnest(range(len(words) - 12)) AS place, words FROM split WHERE len(words) > 12),
named AS (
  SELECT doc_id, place, array_to_string(words[place + 1:place + 13], ' ') AS words FROM windows),
firsts AS (SELECT words, min(doc_id) AS least FROM named GROUP BY words),
marked AS (
  SELECT DISTINCT n.doc_id, n.place + k AS place
  FROM named n JOIN firsts f USING (words), range(13) r(k)
  WHERE n.doc_id > f.least),
judged AS (
  SELECT p.doc_id, p.word, p.place, m.doc_id IS NOT NULL AS gone
  FROM placed p LEFT JOIN marked m USING (doc_id, place)),
sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
       coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""


_MERKLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1
  FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
coded AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS front,
         coalesce(strlen(text) || ':' || text, '-') AS back,
         coalesce(xor(4294967295, list_reduce(
           [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 7 = 0, FALSE) AS tampered
  FROM documents, crc),
hashed AS (
  SELECT doc_id, lang,
         sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         CASE WHEN tampered AND n_chars IS NOT NULL
              THEN sha256(front || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || back) END AS changed
  FROM coded),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT a.tree, a.level + 1, a.place // 2, (a.n + 1) // 2, sha256(a.hash || coalesce(b.hash, ''))
  FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND b.place = a.place + 1
  WHERE a.n > 1 AND a.place % 2 = 0),
subroots AS (SELECT tree, hash AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS place, count(*) OVER () AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT a.level + 1, a.place // 2, (a.n + 1) // 2, sha256(a.hash || coalesce(b.hash, ''))
  FROM tops a LEFT JOIN tops b ON b.place = a.place + 1
  WHERE a.n > 1 AND a.place % 2 = 0),
heights AS (SELECT DISTINCT tree, level FROM nodes WHERE n > 1),
low AS (
  SELECT l.tree, l.place, list(
    CASE WHEN s.hash IS NULL THEN 'none' WHEN s.place % 2 = 1 THEN 'next' || s.hash ELSE 'last' || s.hash END
    ORDER BY h.level) AS steps
  FROM leaves l JOIN heights h ON h.tree = l.tree
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = h.level AND s.place = xor(l.place >> h.level, 1)
  GROUP BY ALL),
high AS (
  SELECT r.tree, list(
    CASE WHEN s.hash IS NULL THEN 'none' WHEN s.place % 2 = 1 THEN 'next' || s.hash ELSE 'last' || s.hash END
    ORDER BY h.level) AS steps
  FROM subroots r, (SELECT DISTINCT level FROM tops WHERE n > 1) h
  LEFT JOIN tops s ON s.level = h.level AND s.place = xor(r.tree >> h.level, 1)
  GROUP BY ALL),
proofs AS (
  SELECT doc_id, leaf, changed, subroot,
         (SELECT hash FROM tops WHERE n = 1) AS root,
         coalesce(low.steps, []) || coalesce(high.steps, []) AS steps
  FROM leaves l JOIN subroots USING (tree)
  LEFT JOIN low ON low.tree = l.tree AND low.place = l.place
  LEFT JOIN high ON high.tree = l.tree),
folded AS (
  SELECT *, list_reduce([coalesce(changed, leaf)] || steps, lambda node, step: sha256(
    CASE step[:4] WHEN 'next' THEN node || step[5:] WHEN 'last' THEN step[5:] || node ELSE node END)) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(steps, lambda s: s[5:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _SUBSTRINGS, "op7_mix_sources": _MIX, "op12_merkle_manifest": _MERKLE}
