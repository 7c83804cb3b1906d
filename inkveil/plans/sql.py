"""The engine's operators once more, as DuckDB SQL: what its queries are checked against."""

from __future__ import annotations

from .. import schema
from ..functions import text as T

K = "doc_id, page_no"
_SPACE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
DATE, YEAR, PIN = (p.replace("\\z", "$") for p in (T.DATE, T.YEAR, T.PIN))
CDN = T.CDN_URL


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def clean(c: str) -> str:
    return f"regexp_replace({c}, '[{_SPACE}\\-\\x{{2013}}\\x{{2014}}.,:''\"]', '', 'g')"


def anchor(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z\\x{{0900}}-\\x{{097F}}/]', '', 'g')"


def as_digit(c: str) -> str:
    return f"translate({c}, '{T.CONFUSED}', '{T.AS_DIGITS}')"


def as_letter(c: str) -> str:
    return f"upper(replace(translate({c}, '{T.MISREAD}', '{T.AS_LETTERS}'), 'ß', 'SS'))"


def digits_of(c: str) -> str:
    return f"CASE WHEN regexp_matches({clean(c)}, '[0-9]') AND regexp_full_match({as_digit(clean(c))}, '[0-9]+') THEN {as_digit(clean(c))} END"


def verhoeff(c: str) -> str:
    n = f"length({c})"
    term = f"({list(T.PERMUTED)})[(i % 8) * 10 + CAST(substr({c}, {n} - i, 1) AS INTEGER) + 1]"
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN list_reduce(list_prepend(0, list_transform(range({n}), lambda i: {term})), "
        f"lambda a, b: ({list(T.DIHEDRAL)})[a * 10 + b + 1]) = 0 ELSE false END"
    )


def read_pan(c: str) -> str:
    raw = clean(c)
    read = f"{as_letter(f'substr({raw}, 1, 5)')} || {as_digit(f'substr({raw}, 6, 4)')} || {as_letter(f'substr({raw}, 10, 1)')}"
    return f"CASE WHEN length({raw}) = 10 AND regexp_full_match({read}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AND substr({read}, 4, 1) IN ({quoted(schema.HOLDER_TYPES)}) THEN {read} END"


def clamp(x: str, y: str, w: str, h: str, width="width", height="height") -> tuple[str, str, str, str]:
    cx = f"least(greatest({x}, 0.0), greatest({width} - 8, 0))"
    cy = f"least(greatest({y}, 0.0), greatest({height} - 8, 0))"
    return cx, cy, f"least(greatest({w}, 8.0), {width} - {cx})", f"least(greatest({h}, 8.0), {height} - {cy})"


def padded(x="x", y="y", w="w", h="h", ratio=0.18, width="width", height="height") -> str:
    g = f"({h} * CAST({ratio} AS DOUBLE))"
    parts = clamp(f"{x} - {g}", f"{y} - {g}", f"{w} + {g} * 2", f"{h} + {g} * 2", width, height)
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(parts, "xywh"))


WORDS = f"""
srclines AS (SELECT {K}, width, height, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM src),
toks AS (SELECT {K}, width, height, row, unnest(ws) AS text, unnest(range(len(ws))) AS ix FROM (SELECT *, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM srclines)),
words AS (SELECT {K}, width, height, row * 1000000 + ix AS word_idx, text,
  CAST(50 + coalesce(sum(length(text)) OVER (PARTITION BY {K}, row ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 18 + ix * 15 AS DOUBLE) AS x,
  CAST(40 + row * 60 AS DOUBLE) AS y, CAST(length(text) * 18 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h FROM toks)"""

_LABEL = " ".join(f"WHEN anchor IN ({quoted(v)}) THEN '{k}'" for k, v in schema.NUMBER_LABELS.items())
LINED = f"""
broken AS (SELECT *, CASE WHEN lag(y) OVER o IS NULL OR NOT (least(lag(y) OVER o + lag(h) OVER o, y + h) - greatest(lag(y) OVER o, y) > least(lag(h) OVER o, h) / 2)
  THEN 1 ELSE 0 END AS brk FROM words WINDOW o AS (PARTITION BY {K} ORDER BY y, x, word_idx)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY {K} ORDER BY y, x, word_idx ROWS UNBOUNDED PRECEDING) - 1 AS line_no FROM broken),
placed AS (SELECT *, row_number() OVER (PARTITION BY {K}, line_no ORDER BY x, word_idx) - 1 AS pos FROM numbered),
lined AS (SELECT *, {digits_of('text')} AS digits, {clean('text')} AS cleaned, {anchor('text')} AS anchor FROM placed)"""

IDS = f"""
num AS (SELECT *, pos - row_number() OVER (PARTITION BY {K}, line_no ORDER BY pos) + 1 AS run_no FROM lined WHERE digits IS NOT NULL),
pre AS (SELECT *, coalesce(sum(length(digits)) OVER (PARTITION BY {K}, line_no, run_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(length(digits)) OVER (PARTITION BY {K}, line_no, run_no) AS total FROM num),
vids AS (SELECT {K}, line_no, min(pos) AS s, max(pos) AS e, 'VID' AS label FROM pre WHERE total = 16 GROUP BY {K}, line_no, run_no),
cand AS (SELECT a.doc_id, a.page_no, a.line_no, a.run_no, a.pos AS s, b.pos AS e, NOT regexp_matches(substr(a.cleaned, 1, 1), '[0-9]') AS confused,
    string_agg(m.digits, '' ORDER BY m.pos) AS number, count(*) = 3 AND min(length(m.digits)) = 4 AND max(length(m.digits)) = 4 AS grouped
  FROM pre a JOIN pre b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line_no = b.line_no AND a.run_no = b.run_no AND b.before + length(b.digits) = a.before + 12
  JOIN pre m ON a.doc_id = m.doc_id AND a.page_no = m.page_no AND a.line_no = m.line_no AND a.run_no = m.run_no AND m.pos BETWEEN a.pos AND b.pos
  WHERE a.total <> 16 GROUP BY ALL),
acc AS (SELECT c.*, (SELECT min(d.s) FROM cand d WHERE d.doc_id = c.doc_id AND d.page_no = c.page_no AND d.line_no = c.line_no AND d.run_no = c.run_no AND d.s > c.e
      AND (regexp_full_match(d.number, '[2-9][0-9]{{11}}') OR (d.confused AND d.grouped))) AS nxt,
    row_number() OVER (PARTITION BY {K}, line_no, run_no ORDER BY s) AS nth
  FROM cand c WHERE regexp_full_match(number, '[2-9][0-9]{{11}}') OR (confused AND grouped)),
greedy AS (SELECT * FROM acc WHERE nth = 1 UNION ALL
  SELECT a.* FROM greedy g JOIN acc a ON a.doc_id = g.doc_id AND a.page_no = g.page_no AND a.line_no = g.line_no AND a.run_no = g.run_no AND a.s = g.nxt),
spans AS (SELECT {K}, line_no, s, e, label FROM vids UNION ALL SELECT {K}, line_no, s, e, 'Aadhaar number' FROM greedy),
spanned AS (SELECT p.doc_id, p.page_no, p.line_no, p.s, p.label, string_agg(m.digits, '' ORDER BY m.pos) AS number, any_value(m.width) AS width, any_value(m.height) AS height,
    min(m.x) AS bx, min(m.y) AS by_, max(m.x + m.w) - min(m.x) AS bw, max(m.y + m.h) - min(m.y) AS bh
  FROM spans p JOIN pre m ON p.doc_id = m.doc_id AND p.page_no = m.page_no AND p.line_no = m.line_no AND m.pos BETWEEN p.s AND p.e GROUP BY p.doc_id, p.page_no, p.line_no, p.s, p.label),
ids AS (SELECT {K}, 1 AS priority, line_no * 1000000 + s AS seq, {padded('bx', 'by_', 'bw', 'bh')}, label, CASE WHEN {verhoeff('number')} THEN 'auto' ELSE 'suggested' END AS source FROM spanned)"""

PANS = f"""
pans AS (SELECT {K}, 2 AS priority, word_idx AS seq, {padded()}, 'PAN' AS label, 'auto' AS source FROM lined WHERE {read_pan('text')} IS NOT NULL)"""

DATES = f"""
near AS (SELECT *, coalesce(bool_or(anchor IN ({quoted(schema.DATE_LABELS)})) OVER (PARTITION BY {K}, line_no ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS labelled FROM lined),
dates AS (SELECT {K}, 3 AS priority, line_no * 1000000 + pos AS seq, {padded()}, 'Date of birth' AS label, 'auto' AS source FROM near
  WHERE regexp_matches(regexp_replace(text, '[{_SPACE}]', '', 'g'), '{DATE}') OR (regexp_matches(cleaned, '{YEAR}') AND labelled))"""

_PAIR = "a.doc_id = c.doc_id AND a.page_no = c.page_no"
LISTS = f"""
told AS (SELECT *, regexp_matches(text, '[0-9]') AS digit, anchor IN ({quoted(schema.FILLER)}) AS filler,
    length(regexp_replace(cleaned, '[^0-9]', '', 'g')) >= 4 AND NOT regexp_matches(cleaned, '{YEAR}') AS reference,
    length(regexp_replace(cleaned, '[^A-Za-z]', '', 'g')) >= 2 AND length(regexp_replace(cleaned, '[^A-Za-z]', '', 'g')) = length(regexp_replace(cleaned, '[.:,]', '', 'g')) AS name_part,
    anchor IN ({quoted(schema.NAME_LABELS)}) AS name_label, CASE {_LABEL} END AS number_label, anchor IN ({quoted(schema.NOT_A_PERSON)}) AS organisation FROM lined),
heads AS (SELECT a.*, EXISTS (SELECT 1 FROM told c WHERE {_PAIR} AND c.line_no = a.line_no AND c.pos > a.pos AND (c.digit OR (c.anchor <> '' AND NOT c.filler))) AS said
  FROM told a WHERE a.number_label IS NOT NULL OR a.name_label),
lists AS (SELECT a.doc_id, a.page_no, a.line_no, a.pos, a.number_label AS kind, a.name_label AS names, a.width, a.height, c.line_no - a.line_no AS lvl, c.pos AS cpos, c.line_no AS cline,
    c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch, c.anchor AS canchor, c.filler, c.reference, c.name_part, c.name_label, c.number_label, c.organisation,
    row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.line_no, a.pos, c.line_no ORDER BY c.pos) AS rn
  FROM heads a JOIN told c ON {_PAIR} AND ((c.line_no = a.line_no AND c.pos > a.pos) OR (NOT a.said AND c.line_no IN (a.line_no + 1, a.line_no + 2)
    AND c.x + c.w > a.x - a.h AND c.x < a.x + greatest(a.w, a.h) * 3)))"""

NUMBERS = f"""
numbers AS (SELECT {K}, 4 AS priority, line_no * 1000000 + pos AS seq, {padded('cx', 'cy', 'cw', 'ch')}, kind AS label, 'suggested' AS source FROM lists
  WHERE kind IS NOT NULL AND rn <= 4 AND reference QUALIFY row_number() OVER (PARTITION BY {K}, line_no, pos ORDER BY lvl, rn) = 1)"""

NAMES = f"""
people AS (SELECT * FROM lists l WHERE names AND NOT EXISTS (SELECT 1 FROM lists o WHERE o.doc_id = l.doc_id AND o.page_no = l.page_no AND o.line_no = l.line_no AND o.pos = l.pos
    AND o.lvl = 0 AND o.rn <= 3 AND o.organisation)),
begun AS (SELECT *, min(CASE WHEN NOT (filler OR canchor = '') THEN rn END) OVER (PARTITION BY {K}, line_no, pos, lvl) AS f FROM people),
ended AS (SELECT *, min(CASE WHEN rn >= f AND NOT (name_part AND NOT name_label AND number_label IS NULL) THEN rn END) OVER (PARTITION BY {K}, line_no, pos, lvl) AS bad FROM begun),
vals AS (SELECT *, min(lvl) OVER (PARTITION BY {K}, line_no, pos) AS best FROM ended WHERE rn >= f AND rn < f + 5 AND (bad IS NULL OR rn < bad)),
mine AS (SELECT *, min(line_no * 1000000 + pos) OVER (PARTITION BY {K}, cline, cpos) AS claim FROM vals WHERE lvl = best),
named AS (SELECT {K}, line_no, pos, any_value(width) AS width, any_value(height) AS height, min(cx) AS bx, min(cy) AS by_, max(cx + cw) - min(cx) AS bw, max(cy + ch) - min(cy) AS bh
  FROM mine GROUP BY {K}, line_no, pos HAVING bool_or(claim = line_no * 1000000 + pos)),
names AS (SELECT {K}, 5 AS priority, line_no * 1000000 + pos AS seq, {padded('bx', 'by_', 'bw', 'bh')}, 'Name' AS label, 'suggested' AS source FROM named)"""

ADDRESSES = f"""
bands AS (SELECT {K}, line_no, any_value(width) AS width, any_value(height) AS height, bool_or(coalesce(regexp_full_match(digits, '[0-9]{{6}}'), false)) AS pin,
    min(CASE WHEN anchor IN ({quoted(schema.ADDRESS_LABELS)}) THEN pos END) AS start FROM lined GROUP BY {K}, line_no),
stops AS (SELECT a.*, coalesce((SELECT min(c.line_no) FROM bands c WHERE {_PAIR} AND c.pin AND c.line_no BETWEEN a.line_no + 1 AND a.line_no + 6),
    (SELECT max(c.line_no) FROM bands c WHERE {_PAIR} AND c.line_no BETWEEN a.line_no AND a.line_no + 6)) AS stop FROM bands a WHERE start IS NOT NULL),
hops AS (SELECT a.*, (SELECT min(c.line_no) FROM stops c WHERE {_PAIR} AND c.line_no > a.stop) AS nxt, row_number() OVER (PARTITION BY {K} ORDER BY line_no) AS nth FROM stops a),
taken AS (SELECT * FROM hops WHERE nth = 1 UNION ALL SELECT c.* FROM taken a JOIN hops c ON {_PAIR} AND c.line_no = a.nxt),
held AS (SELECT a.doc_id, a.page_no, a.line_no, a.start, any_value(a.width) AS width, any_value(a.height) AS height, min(c.x) AS bx, min(c.y) AS by_, max(c.x + c.w) - min(c.x) AS bw, max(c.y + c.h) - min(c.y) AS bh
  FROM taken a JOIN lined c ON {_PAIR} AND ((c.line_no = a.line_no AND c.pos >= a.start) OR (c.line_no > a.line_no AND c.line_no <= a.stop)) GROUP BY a.doc_id, a.page_no, a.line_no, a.start),
addresses AS (SELECT {K}, 6 AS priority, line_no * 1000000 + start AS seq, {padded('bx', 'by_', 'bw', 'bh', 0.03)}, 'Address' AS label, 'auto' AS source FROM held)"""

_COVER = "greatest(0.0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0.0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) / (b.w * b.h)"
BOXES = f"""
found AS (SELECT * FROM ids UNION ALL SELECT * FROM pans UNION ALL SELECT * FROM dates UNION ALL SELECT * FROM numbers UNION ALL SELECT * FROM names UNION ALL SELECT * FROM addresses),
listed AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY priority, seq, x, y, w, h, label, source) AS nth, count(*) OVER (PARTITION BY {K}) AS total,
    struct_pack(priority := priority, seq := seq, x := x, y := y, w := w, h := h, label := label, source := source) AS b FROM found),
folded AS (SELECT {K}, nth, total, [b] AS kept FROM listed WHERE nth = 1 UNION ALL
  SELECT l.doc_id, l.page_no, l.nth, l.total, CASE WHEN len(list_filter(f.kept, lambda k: {_COVER.replace('b.', 'l.b.')} > 0.6)) > 0 THEN f.kept ELSE list_append(f.kept, l.b) END
  FROM folded f JOIN listed l ON l.doc_id = f.doc_id AND l.page_no = f.page_no AND l.nth = f.nth + 1),
boxes AS (SELECT {K}, unnest(kept, recursive := true) FROM folded WHERE nth = total)"""


def cards(phone_base: int = 9_000_000_000) -> str:
    k = "CAST(c_custkey AS BIGINT)"
    letters = lambda n: " || ".join(f"chr(CAST({k} // {26**i} % 26 + 65 AS INTEGER))" for i in range(n))
    stem = f"(CAST({k} % 8 + 2 AS VARCHAR) || lpad(CAST({k} * 7919 % 10000000000 AS VARCHAR), 10, '0'))"
    return f"""
stems AS (SELECT c_custkey, c_name, n_name, {stem} AS stem FROM customer JOIN nation ON c_nationkey = n_nationkey),
checks AS (SELECT s.*, d.d AS chk FROM stems s, (SELECT unnest(range(10)) AS d) d WHERE {verhoeff("(s.stem || CAST(d.d AS VARCHAR))")}),
nums AS (SELECT *, stem || CAST(CASE WHEN c_custkey % 3 = 0 THEN (chk + 1) % 10 ELSE chk END AS VARCHAR) AS number FROM checks),
src AS (SELECT {k} AS doc_id, 0 AS page_no, 1000 AS width, 600 AS height, concat_ws(chr(10),
  'Name: ' || translate(substr(c_name, 10), '0123456789', 'ABCDEFGHIJ'),
  'DOB: ' || lpad(CAST({k} % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST({k} % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST({k} % 50 + 1950 AS VARCHAR),
  substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 4),
  'Mobile ' || CAST({k} * 104729 % 1000000000 + {phone_base} AS VARCHAR),
  'Address: H.No ' || CAST({k} AS VARCHAR) || ', ' || n_name,
  'Pune ' || CAST({k} % 99999 + 400000 AS VARCHAR),
  {letters(3)} || 'P' || {letters(1)} || lpad(CAST({k} % 10000 AS VARCHAR), 4, '0') || {letters(1)}) AS text FROM nums)"""


DOCUMENTS = f"src AS (SELECT doc_id, 0 AS page_no, 100000000 AS width, 100000000 AS height, coalesce(text, '') AS text FROM documents)"
_OUT = "doc_id, CAST(priority AS BIGINT) AS priority, CAST(seq AS BIGINT) AS seq, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, label, source"


def chain(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select


def detector(source: str, name: str, *parts: str) -> str:
    return chain(source, WORDS, LINED, *parts, select=f"SELECT {_OUT} FROM {name}")


ALL = (IDS, PANS, DATES, LISTS, NUMBERS, NAMES, ADDRESSES, BOXES)
