"""SQL for the operators that SQL can express: DuckDB gives the same rows over whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 of a column's decimal digits: eight shifts a byte.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"

SQL: dict[str, str] = {
    "op2_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST([3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS fill FROM r),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM f),
v AS (SELECT *, (budget - capped) / open_w AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, {{a: fill, b: level}}) FROM v WHERE level <= fill) * w, cap)) AS target FROM v),
c AS (SELECT d.*, source_size, target, row_number() OVER w AS place, sum(size) OVER w AS cum, coalesce('s' || d.source, '') AS g FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
    WINDOW w AS (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN target > 0 THEN CAST(source_size * turn + cum AS DOUBLE) / target ELSE 0 END AS finish FROM c CROSS JOIN (VALUES (0), (1)) x(turn)),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id NULLS FIRST, g, place, turn ROWS UNBOUNDED PRECEDING) AS used FROM q)
SELECT doc_id, size, source_size, target, CAST(size * count(*) FILTER (WHERE used <= (SELECT floor(sum(size) * 1.5) FROM d)) AS BIGINT) AS taken FROM u GROUP BY g, place, doc_id, size, source_size, target""",
    "op3_substring": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (k) WHERE first < doc_id),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j WHERE c.j IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op9_lines": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM d),
b AS (SELECT *, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS bare FROM x),
n AS (SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, md5(bare) AS h FROM b WHERE bare <> ''),
p AS (SELECT *, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM n),
e AS (SELECT h, h2, min({{d: doc_id, i: i}}) AS first FROM p WHERE h2 IS NOT NULL GROUP BY 1, 2),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM p JOIN e USING (h, h2) WHERE {{d: doc_id, i: i}} > first),
o AS (SELECT n.doc_id, n.j, n.i FROM n JOIN g ON g.doc_id = n.doc_id AND g.i = n.i),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT before) AS n_spans FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1, false) AS before FROM o) GROUP BY 1),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.j) AS kept FROM x LEFT JOIN o ON o.doc_id = x.doc_id AND o.j = x.j WHERE o.j IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce((SELECT count(*) FROM n WHERE n.doc_id = d.doc_id), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_trie": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, list({{role: role, text: text}} ORDER BY part, pos) AS turns FROM r GROUP BY 1),
f AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[:d] AS seq, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM f)),
k AS (SELECT *, md5(CAST(list_transform(seq, lambda x: md5(x.role) || md5(x.text)) AS VARCHAR)) AS key FROM p),
v AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM k GROUP BY 1),
o AS (SELECT v.*, w.key AS parent, w.conv_id AS parent_conv_id FROM v LEFT JOIN k ON k.conv_id = v.conv_id AND k.depth = v.depth - 1 LEFT JOIN v w ON w.key = k.key),
n AS (SELECT parent AS key, count(*) AS n_children FROM o WHERE parent IS NOT NULL GROUP BY 1),
g AS (SELECT k.key, count(*) FILTER (WHERE n.key IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved_tokens FROM o JOIN k ON k.conv_id = o.conv_id AND k.depth <= o.depth LEFT JOIN n ON n.key = o.key GROUP BY 1)
SELECT o.conv_id, o.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM o JOIN g ON g.key = o.key LEFT JOIN n ON n.key = o.key""",
}
