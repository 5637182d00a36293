"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import secret_scan

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x,
    row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS n,
    first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS top FROM p),
b AS (SELECT *, [('0x' || substr(x, 1 + 5 * g, 5))::BIGINT for g in range(8)] AS fives FROM d)
SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], '') AS payload_digest,
    CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n > 1 THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM b
"""

OP2 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
l AS (SELECT DISTINCT n FROM v),
s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n),
f AS (SELECT s.r, s.s, s.n, v.item FROM (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM s) s JOIN v ON v.k = s.k AND v.n = s.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_CONTROL = "(\\\\*)(</?s>|\\[/?INST\\])"
OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\\\\\\1\\2', 'g'))
    + CASE WHEN role = 'assistant' THEN 6 ELSE 16 + length(regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '{_CONTROL}', '\\\\\\1\\2', 'g')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9 = f"""
WITH t AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents),
k AS (SELECT row_number() OVER () AS k, x, regexp_extract_all({_LOWER.format("x")}, '{_WORD}') AS w FROM t),
s AS (SELECT k, unnest(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM k WHERE len(w) > 0),
z AS (SELECT k, count(*) AS z FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 10 * m >= 8 * (x.z + y.z - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT k, k FROM k UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b) SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a),
d AS (SELECT doc_id, k, c FROM documents JOIN k ON x = coalesce(text, '') JOIN r ON a = k)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, coalesce(n, 0) AS n_links, count(*) OVER (PARTITION BY d.k) AS n_copies
FROM d LEFT JOIN n ON n.a = d.k
"""

_DRAW = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
OP10 = f"""
WITH d AS (SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, source, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT key, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY key),
q AS (SELECT tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS p FROM s WHERE tokens > 0),
x1 AS (SELECT min(a) AS a FROM (SELECT a, pow(min(p), a / 1000000.0::DOUBLE - 1) / sum(pow(p, a / 1000000.0::DOUBLE)) <= 2 AS ok FROM q, (SELECT unnest(range(0, 1000001, 10000)) AS a) GROUP BY a) WHERE ok),
x2 AS (SELECT min(a) AS a FROM (SELECT a, pow(min(p), a / 1000000.0::DOUBLE - 1) / sum(pow(p, a / 1000000.0::DOUBLE)) <= 2 AS ok FROM q, (SELECT unnest(range(greatest(a - 10000, 0), a + 1, 100)) AS a FROM x1) GROUP BY a) WHERE ok),
x AS (SELECT min(a) AS a FROM (SELECT a, pow(min(p), a / 1000000.0::DOUBLE - 1) / sum(pow(p, a / 1000000.0::DOUBLE)) <= 2 AS ok FROM q, (SELECT unnest(range(greatest(a - 100, 0), a + 1)) AS a FROM x2) GROUP BY a) WHERE ok),
w AS (SELECT key, tokens, docs, CASE WHEN tokens > 0 THEN pow(tokens / CAST(sum(tokens) OVER () AS DOUBLE), (SELECT a FROM x) / 1000000.0::DOUBLE) ELSE 0 END AS power FROM s),
t AS (SELECT key, CAST(tokens AS BIGINT) AS tokens, CAST(round(power / sum(power) OVER () * 1000000000) AS BIGINT) AS weight_ppb,
    CAST((tokens + docs + 1048575) // 1048576 AS BIGINT) AS n_blocks FROM w),
g AS (SELECT *, CAST((CAST(weight_ppb AS HUGEINT) * (SELECT sum(tokens) FROM s)) // 1000000000 AS BIGINT) AS target FROM t),
b AS (SELECT d.*, {_DRAW.format("'7|' || id")} AS draw, {_DRAW.format("'7|' || id")} % n_blocks AS block, weight_ppb, target, tokens
    FROM d JOIN g USING (key) WHERE target > 0),
i AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY key, block ORDER BY draw, id, n_tokens, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
k AS (SELECT key, block, sum(n_tokens) AS n, any_value(tokens) AS tokens, any_value(target) AS target FROM b GROUP BY key, block),
r AS (SELECT *, unnest(range(0, (target - 1) // tokens + 1)) AS pass_no FROM k),
o AS (SELECT key, block, pass_no, pass_no * tokens + coalesce(sum(n) OVER (PARTITION BY key, pass_no
    ORDER BY {_DRAW.format("'7|' || key || '|' || pass_no || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, pass_no, i.block, CAST(start + before AS DOUBLE) / target AS position, weight_ppb
FROM i JOIN o USING (key, block) WHERE start + before < target
"""

_CRC = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC.append(_byte)
OP11 = f"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || '|' || coalesce(role, '') || coalesce(text, '')) AS said, octet_length(encode(coalesce(text, ''))) AS size, turn FROM conversations),
a AS (SELECT conv_id, said, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos FROM t),
b AS (SELECT [4294967295::BIGINT] || [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(conv_id AS VARCHAR), '')] AS bytes, conv_id FROM (SELECT DISTINCT conv_id FROM a) u),
h AS (SELECT conv_id, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, ({_CRC})[1 + (xor(x, y) & 255)])), 4294967295::BIGINT) % 9 AS h FROM b),
n AS (SELECT conv_id, count(*) AS n FROM a GROUP BY conv_id),
k AS (SELECT h.conv_id, h, least(h, coalesce(n, 0)) AS k FROM h LEFT JOIN n ON n.conv_id = h.conv_id - h.conv_id % 5),
r AS (SELECT k.conv_id, pos - h + k AS pos, said, size FROM a JOIN k ON k.conv_id = a.conv_id WHERE pos > h
    UNION ALL SELECT k.conv_id, pos, said, size FROM a JOIN k ON a.conv_id = k.conv_id - k.conv_id % 5 WHERE pos <= h),
p AS (SELECT conv_id, pos, size, array_to_string(list(said) OVER (PARTITION BY conv_id ORDER BY pos), ',') AS key FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM k),
v AS (SELECT key, min(conv_id) AS conv_id, min(pos) AS depth, count(*) AS n_convs, max(size) AS size, substr(key, 1, greatest(length(key) - 33, 0)) AS parent FROM p GROUP BY key),
c AS (SELECT parent AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY parent),
s AS (SELECT p.key, sum((n_convs - 1) * v.size) AS saved_tokens, count(*) FILTER (c.key IS NULL) AS n_leaves
    FROM p JOIN v ON v.conv_id = p.conv_id AND p.pos <= v.depth LEFT JOIN c ON c.key = v.key GROUP BY p.key),
l AS (SELECT conv_id, max(pos) AS last FROM p GROUP BY conv_id),
e AS (SELECT key, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ends FROM p JOIN l ON l.conv_id = p.conv_id AND l.last = p.pos GROUP BY key)
SELECT v.conv_id, v.depth, CASE WHEN v.depth > 0 THEN o.conv_id END AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN v o ON o.key = v.parent LEFT JOIN c ON c.key = v.key LEFT JOIN e ON e.key = v.key JOIN s ON s.key = v.key
"""

_ASSIGN = secret_scan.BASE["assign"][0].replace("'", "''")
_SUMS = "[" + ", ".join(map(str, secret_scan.log_sums())) + "]"
_TOPS = [secret_scan.highest_sum(h) for _, h in secret_scan.CLASSES.values()]


def _places(kind: str, pattern: str, group: int, least: int, docs: str = "d") -> str:
    """Leftmost matches with their places: each starts after the pieces and matches before it."""
    return f"""SELECT r, '{kind}' AS kind, said, start, start + length(said) AS stop FROM (
    SELECT r, m[i] AS said, c[i] AS counted, CAST(list_sum([length(x) for x in g[:i]]) + coalesce(list_sum([length(x) for x in m[: i - 1]]), 0) AS BIGINT) AS start
    FROM (SELECT r, m, g, c, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m,
        string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', {group}) AS c FROM {docs}) x) y) z WHERE length(counted) >= {least}"""


_ALLOWED = " OR ".join(f"regexp_matches(said, '{p}')" for p in secret_scan.ALLOWED)
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_places("assign", _ASSIGN, 2, 8)} UNION ALL {_places("access", "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_places("hex", "[0-9a-f]{32,}", 0, 32)}),
c AS ({_places("entropy", secret_scan.CANDIDATE, 0, secret_scan.WINDOW)}),
f AS (SELECT r, said, start, CASE WHEN regexp_matches(said, '{secret_scan.CLASSES["hex"][0]}') THEN {_TOPS[0]}
    WHEN regexp_matches(said, '{secret_scan.CLASSES["one case"][0]}') THEN {_TOPS[1]} ELSE {_TOPS[2]} END AS top
    FROM c WHERE NOT ({_ALLOWED})
    AND len(list_filter(string_split_regex(said, '{secret_scan.SLUG_BREAK}'), lambda p: NOT regexp_matches(p, '{secret_scan.SLUG_PART}'))) > 0),
w AS (SELECT r, start AS s, start + i - 1 AS a, substr(said, i, {secret_scan.WINDOW}) AS w, top
    FROM (SELECT r, said, start, top, unnest(range(1, length(said) - {secret_scan.WINDOW} + 2)) AS i FROM f) x),
h AS (SELECT r, s, a FROM w WHERE list_sum([{_SUMS}[1 + length(w) - length(replace(w, x, ''))] for x in list_distinct(string_split(w, ''))]) <= top),
o AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY r, s ORDER BY a) <= {secret_scan.WINDOW} THEN 0 ELSE 1 END AS fresh FROM h),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r, s ORDER BY a) AS island FROM o),
e AS (SELECT r, min(a) AS start, max(a) + {secret_scan.WINDOW} AS stop FROM n GROUP BY r, s, island),
k AS (SELECT r, kind, start, stop FROM b UNION ALL SELECT r, 'entropy', start, stop FROM e
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = e.r AND b.start <= e.start AND e.stop <= b.stop)),
l AS (SELECT *, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS rank, kind || ':' || start || ':' || stop AS said FROM k),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, rank, stop) AS spans, string_agg(said, ',' ORDER BY start, rank, stop) FILTER (rank < 4) AS base FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

CHECKS = {
    "op1_warc": OP1, "op2_decontamination": OP2, "op7_chat_format": OP7, "op9_lsh_forest": OP9, "op10_mixing": OP10, "op11_prefix_trie": OP11,
    "op12_secret_scan": OP12,
}
