"""Operators 11 to 13 once more, as SQL that DuckDB runs on the same tables."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {letters}, lambda c, b: {bits}), 4294967295)"


_NAME = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
REPAIR = rf"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_NAME)} % 20 AS code FROM conversations),
rows_ AS (
    SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(text), role, copy) - 1 AS i FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
r AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault
    FROM seen),
facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 0 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM r GROUP BY conv_id),
filled(src, mid, cost, audit, made) AS (VALUES
    (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edit(e, role, src, dst) AS (VALUES
    ('D', '', 0, 0), ('D', '', 1, 1), ('D', '', 2, 2), ('D', '', 3, 3), ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'u', 3, 2), ('K', 'a', 2, 3),
    ('R', 'user', 0, 2), ('R', 'user', 1, 2), ('R', 'user', 3, 2), ('R', 'assistant', 2, 3)),
walk AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'made': []::VARCHAR[]}} AS best FROM facts
    UNION ALL
    SELECT w.conv_id, w.i + 1, e.dst, min({{
        'cost': w.best.cost + f.cost + CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (e.e <> 'D' AND r.fault = 'truncated')::INT,
        'audit': w.best.audit || f.audit || e.e,
        'made': w.best.made || f.made || CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.role || ':' || r.text] END}})
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i JOIN filled f ON f.src = w.state JOIN edit e ON e.src = f.mid
    WHERE e.e = 'D' OR r.fault IN ('ok', 'truncated') AND (e.e = 'R' OR e.role = substr(r.role, 1, 1))
    GROUP BY w.conv_id, w.i, e.dst),
done AS (
    SELECT w.conv_id, min({{'cost': w.best.cost + f.cost, 'audit': w.best.audit || f.audit, 'made': w.best.made || f.made}}) AS best
    FROM walk w JOIN facts x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.i
    JOIN filled f ON f.src = w.state AND (f.mid = 3 AND (f.src > 0) OR f.src = 0 AND f.mid = 0)
    GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(x.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(d.best.cost, 0)::BIGINT AS cost, coalesce(d.best.audit, '') AS audit,
    sha256(coalesce(array_to_string(d.best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
MERKLE = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
        CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_field("text")}) END AS claimed
    FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS idx, count(*) OVER (PARTITION BY source) AS wide FROM d),
n AS (
    SELECT source, 0 AS level, idx, leaf AS digest, wide FROM leaves
    UNION ALL
    SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((wide + 2) // 3) FROM n WHERE wide > 1 GROUP BY source, level, idx // 3),
tops AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS wide FROM n WHERE wide = 1),
m AS (
    SELECT 0 AS level, idx, subroot AS digest, wide FROM tops
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((wide + 2) // 3) FROM m WHERE wide > 1 GROUP BY level, idx // 3),
way AS (
    SELECT l.doc_id, s.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < l.idx // (3 ** s.level)::BIGINT), '') AS lft,
        coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > l.idx // (3 ** s.level)::BIGINT), '') AS rgt
    FROM leaves l JOIN n s ON s.source IS NOT DISTINCT FROM l.source AND s.wide > 1 AND s.idx // 3 = l.idx // (3 ** (s.level + 1))::BIGINT GROUP BY ALL
    UNION ALL
    SELECT l.doc_id, 1000 + s.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < t.idx // (3 ** s.level)::BIGINT), ''),
        coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > t.idx // (3 ** s.level)::BIGINT), '')
    FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN m s ON s.wide > 1 AND s.idx // 3 = t.idx // (3 ** (s.level + 1))::BIGINT GROUP BY ALL),
step AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) - 1 AS k FROM way),
climb AS (
    SELECT doc_id, 0::BIGINT AS k, claimed AS digest FROM leaves
    UNION ALL
    SELECT c.doc_id, c.k + 1, sha256(s.lft || c.digest || s.rgt) FROM climb c JOIN step s ON s.doc_id = c.doc_id AND s.k = c.k),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(lft || rgt, '' ORDER BY k), '')) AS proof_sha256 FROM step GROUP BY doc_id)
SELECT l.doc_id, l.leaf, t.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, c.digest AS folded_root, c.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN m r ON r.wide = 1
JOIN (SELECT doc_id, arg_max(digest, k) AS digest FROM climb GROUP BY doc_id) c ON c.doc_id = l.doc_id LEFT JOIN proof p ON p.doc_id = l.doc_id"""


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


MIXING = f"""
WITH d AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
c AS (
    SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 - 8 + (size >> (length(bin(size)) - 4)) END AS class FROM d),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0) AS filled, coalesce(sum(weight) OVER before, 0) AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
    FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * total - 2.0::DOUBLE * filled) / (weights - used)) AS level FROM o),
t AS (SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target FROM s, level),
k AS (SELECT *, {_draw("'13'", "doc_id::VARCHAR")} % ceil(sqrt(count(*) OVER (PARTITION BY source, class)))::BIGINT AS chunk FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, chunk, size DESC, doc_id NULLS FIRST) AS place FROM k),
q AS (
    SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate, p.place,
        ({_draw("'13:offset'", "p.source")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS off
    FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (least(floor(off + rate * place) - floor(off + rate * (place - 1)), ceil(rate)) * size)::BIGINT AS taken FROM q"""
