"""SQL equivalents, for DuckDB, of the operators that SQL can express.  Rows are told apart by their number, as ids may repeat."""

from __future__ import annotations

from gleaner.llm.substrings import WINDOW

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM d WHERE len(ws) >= {WINDOW}),
k AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM s),
h AS (SELECT r, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM h),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
e AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM t ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN e USING (r)
"""

_SHARD = "list_reduce([{{'u': CAST('0x' || substr(md5('1:' || i || ':' || t), 1, 12) AS BIGINT), 's': i}} for i in range({n})], lambda a, b: CASE WHEN b.u > a.u OR (b.u = a.u AND b.s > a.s) THEN b ELSE a END).s"
SHARDS = rf"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, c),
s AS (SELECT *, CAST({_SHARD.format(n=8)} AS INT) AS shard, CAST({_SHARD.format(n=9)} AS INT) AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(t), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
