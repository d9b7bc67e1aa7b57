"""What the prefix trie of op11 gives, in SQL."""

from framewright.llm.resampling_sql import CRC_TABLE, crc32

OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
y AS (SELECT *, sha256(octet_length(encode(role)) || ':' || role || text) AS digest FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS i FROM y),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
u AS (SELECT c.conv_id, 0 AS own, i, digest, text FROM c JOIN o ON o.conv_id = c.head AND i <= h
      UNION ALL SELECT c.conv_id, 1, i, digest, text FROM c JOIN o USING (conv_id) WHERE i > h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM u),
q AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             sha256(array_to_string(list(digest) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), '')) AS key FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
p AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM q),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(words) AS words,
             sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
s AS (SELECT p.d, p.key, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words)::BIGINT AS saved_tokens
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.key)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (d, key) LEFT JOIN n up ON up.d = m.d - 1 AND up.key = m.parent
"""
