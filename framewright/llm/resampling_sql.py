"""What the resampling of op12 gives, in SQL."""

#: CRC-32 of a text's UTF-8 bytes, for a query that has the relation ``crc_table``
CRC_TABLE = """
crc_bits(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc32(text: str) -> str:
    """The expression for the CRC of ``text`` where ``t`` of crc_table is in scope."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr({digits}, 2 * k + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), {step}))"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
dw AS (SELECT r, unnest(words) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, {crc32('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000.0::DOUBLE)
          / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000.0::DOUBLE))))::BIGINT AS gain
      FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(gain) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM z
"""
