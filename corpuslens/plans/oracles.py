"""SQL that gives the same rows as the registered queries, for an engine whose patterns have no look-around."""

from __future__ import annotations

from ..operators import patterns as P
from . import fixtures as X

#: For patterns of ASCII words: other characters count as word characters.
_MASKED = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docs(expression: str) -> str:
    return f"(SELECT doc_id, {expression} AS text FROM {_RAW})"


_RAW = "(SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents)"
_SETS = f"(SELECT {X.SET_OF} AS doc_set_id, doc_id FROM documents)"


def _hits(docs: str, pattern: str, text: str = "text", label: str = "''", options: str = "") -> str:
    """``(doc_id, nth, start, line_no, text, label)`` of matches."""
    p = _quoted(pattern)
    o = f", 0, {_quoted(options)}" if options else ""
    o2 = f", {_quoted(options)}" if options else ""
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    feeds = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y) - length(replace(y, chr(10), '')))), 0)"
    return f"""
SELECT doc_id, i - 1 AS nth, CAST({total('gs[1:i]')} + {total('ms[1:i - 1]')} AS BIGINT) AS start, CAST(1 + {feeds('gs[1:i]')} + {feeds('ms[1:i - 1]')} AS INTEGER) AS line_no, ms[i] AS text, {label} AS label
FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({text}, {p}{o}) AS ms, string_split_regex({text}, {p}{o2}) AS gs FROM {docs}))"""


def _lines(docs: str) -> str:
    return f"""
SELECT *, coalesce(sum(CAST(is_fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences
FROM (SELECT doc_id, line_no, raw, stripped, starts_with(stripped, '```') AS is_fence
  FROM (SELECT doc_id, line_no, raw, {_TRIM.format('raw')} AS stripped
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM {docs})))"""


_AUDIT = f"(SELECT doc_id, {X.AUDIT} AS text FROM {_RAW} UNION ALL SELECT -1 - doc_id, {X.CHINESE} FROM {_RAW} WHERE doc_id % 5 = 0)"
_CONS, _FACTS, _MD = (_docs(x) for x in (X.CONSISTENCY, X.FACTS, X.MARKDOWN))
_NO_CODE = r"regexp_replace(regexp_replace(text, '(^|\n)[ \t]*```[^\n]*\n(?:[^\n]*\n)*?[ \t]*```[^\n]*', '\1', 'g'), '`[^`\n]+`', '', 'g')"
_LANG = "CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) >= len(regexp_extract_all(text, '[A-Za-z]')) THEN 'zh' ELSE 'en' END"


def _ai() -> str:
    parts = " UNION ALL ".join(_hits(_AUDIT, p, label=_quoted(label)) for p, label in P.AI_PATTERNS)
    return f"SELECT doc_id, line_no, start, label, substring(text, 1, 40) AS text FROM ({parts})"


def _filler() -> str:
    return "SELECT doc_id, line_no, start, text FROM (" + " UNION ALL ".join(_hits(_AUDIT, w) for w in P.FILLERS) + ")"


def _gaps() -> str:
    parts = " UNION ALL ".join(_hits(_AUDIT, k + r"\s*\d+", label=_quoted(k)) for k in (P.FIGURE, P.TABLE))
    return f"""
SELECT doc_id, label AS kind, nth AS seq, CAST(found AS VARCHAR) AS found, CAST(expected AS VARCHAR) AS expected FROM (
  SELECT *, greatest(1, coalesce(max(found) OVER (PARTITION BY doc_id, label ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) AS expected
  FROM (SELECT doc_id, label, CAST(nth AS INTEGER) AS nth, CAST(regexp_extract(text, '\\d+') AS BIGINT) AS found FROM ({parts})))
WHERE found > expected"""


def _quotes() -> str:
    by_language = f"(SELECT doc_id, text, {_LANG} AS language FROM {_AUDIT})"
    zh = _lines(f"(SELECT doc_id, text FROM {by_language} WHERE language = 'zh')")
    en = _hits(f"(SELECT doc_id, text FROM {by_language} WHERE language = 'en')", "[“”]")
    return f"""
SELECT doc_id, 'zh' AS language, CAST(line_no AS INTEGER) AS line_no, substring(stripped, 1, 50) AS text FROM ({zh}) WHERE NOT is_fence AND fences % 2 = 0 AND contains(raw, '"')
UNION ALL SELECT doc_id, 'en', line_no, text FROM ({en})"""


def _empty() -> str:
    parts = [f"SELECT doc_id, line_no, 'heading' AS kind, {i} AS rule, stripped FROM l WHERE starts_with(stripped, '#') AND regexp_matches(stripped, {_quoted(p)})" for i, p in enumerate(P.EMPTY_HEADINGS)]
    prose = r"NOT starts_with(stripped, '#') AND length(stripped) BETWEEN 1 AND 119 AND regexp_matches(stripped, '^[^#|>`\-\d*!]')"
    parts += [f"SELECT doc_id, line_no, 'line', {i}, stripped FROM l WHERE {prose} AND regexp_matches(stripped, {_quoted(p)})" for i, p in enumerate(P.EMPTY_LINES)]
    return f"WITH l AS ({_lines(_AUDIT)}) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, rule, substring(stripped, 1, 40) AS text FROM ({' UNION ALL '.join(parts)})"


def _terms() -> str:
    body = f"(SELECT doc_id, {_MASKED} AS text FROM (SELECT doc_id, {_NO_CODE} AS text FROM {_AUDIT}))"
    parts = " UNION ALL ".join(f"SELECT doc_id, {_quoted(name)} AS term, list_sort(list_distinct(regexp_extract_all(text, {_quoted(p)}, 1))) AS ways FROM b" for p, name in P.TERM_VARIANTS)
    return f"WITH b AS {body} SELECT doc_id, term, array_to_string(ways, '、') AS variants FROM ({parts}) WHERE len(ways) > 1"


def _fences() -> str:
    return f"""
SELECT doc_id, fences, fences % 2 = 1 AS unclosed, CAST(len(bare) AS INTEGER) AS unlabelled, coalesce(array_to_string(bare[1:5], '、'), '') AS lines FROM (
  SELECT doc_id, count(*) AS fences, coalesce(list(line_no ORDER BY line_no) FILTER (fences % 2 = 0 AND trim(substring(stripped, 4)) = ''), []) AS bare FROM ({_lines(_AUDIT)}) WHERE is_fence GROUP BY doc_id)
WHERE fences % 2 = 1 OR len(bare) > 0"""


def _sections() -> str:
    p = _quoted(P.SECTION)
    return f"""
WITH s AS (
  SELECT doc_id, line_no, length(regexp_extract(raw, {p}, 1)) AS level, regexp_extract(raw, {p}, 2) AS number FROM ({_lines(_AUDIT)}) WHERE regexp_matches(raw, {p})),
w AS (SELECT *, len(string_split(number, '.')) AS depth, lag(level) OVER o AS last_level, lag(len(string_split(number, '.'))) OVER o AS last_depth FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, number, 'depth' AS kind FROM w WHERE depth > last_depth + 1
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), number, 'level' FROM w WHERE level > last_level + 1"""


def _report() -> str:
    checks = {"ai": _ai(), "filler": _filler(), "figure_table": _gaps(), "quote": _quotes(), "empty": _empty(), "term": _terms(), "section": _sections()}
    n = ", ".join(f"c_{k} AS (SELECT doc_id, count(*) AS n FROM ({sql}) GROUP BY doc_id)" for k, sql in checks.items())
    code = f"c_code AS (SELECT doc_id, CAST(unclosed AS INTEGER) + CAST(unlabelled > 0 AS INTEGER) AS n FROM ({_fences()}))"
    kinds = [k for k, _, _ in P.PENALTIES]
    joins = " ".join(f"LEFT JOIN c_{k} ON c_{k}.doc_id = d.doc_id" for k in kinds)
    counts = ", ".join(f"CAST(coalesce(c_{k}.n, 0) AS BIGINT) AS n_{k}" for k in kinds)
    lost = " - ".join(f"least(n_{k} * {w}, {cap})" for k, w, cap in P.PENALTIES)
    return f"""
WITH {n}, {code}, j AS (
  SELECT d.doc_id, {_LANG} AS language, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, {counts} FROM {_AUDIT} d {joins})
SELECT *, greatest(100 - {lost}, 0) AS score, greatest(100 - {lost}, 0) >= {P.GOOD_SCORE} AS good FROM j"""


def _audit_sections() -> str:
    at = "'L' || CAST(line_no AS VARCHAR) || ' ' || "
    parts = [("ai", "start", at + "'[' || label || '] ' || text", _ai()), ("filler", "start", at + "text", _filler()), ("figure_table", "seq", "kind || found || ' / ' || kind || expected", _gaps()), ("quote", "line_no", at + "text", _quotes()), ("empty", "line_no", at + "text", _empty()), ("term", "0", "term || ': ' || variants", _terms()), ("section", "line_no", at + "number || ' ' || kind", _sections())]
    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS section, {no} AS no, {item} AS item FROM ({sql})" for name, no, item, sql in parts)
    return f"""
SELECT doc_id, section, any_value(n) AS n, string_agg(item, chr(10) ORDER BY k) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY no, item) AS k, count(*) OVER (PARTITION BY doc_id, section) AS n FROM ({rows})) WHERE k <= 8 GROUP BY doc_id, section"""


def _sentences() -> str:
    ends = P.SENTENCE_ENDS
    return f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM (
  SELECT doc_id, line_no, unnest(range(len(parts))) AS sent_no, {_TRIM.format('unnest(parts)')} AS sentence
  FROM (SELECT doc_id, line_no, regexp_extract_all(raw, '[^{ends}]*[{ends}]|[^{ends}]+$') AS parts FROM ({_lines(_CONS)})))
WHERE sentence <> ''"""


def _delay() -> str:
    return f"""
WITH s AS ({_sentences()}),
p AS (
  SELECT a.doc_id, a.line_no, a.sent_no, a.sentence, b.line_no AS other_line, b.sentence AS other,
    row_number() OVER (PARTITION BY a.doc_id, a.line_no, a.sent_no ORDER BY b.line_no, b.sent_no) AS k
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) <= {P.DELAY_REACH}
  WHERE regexp_matches(a.sentence, {_quoted('(?i)' + P.DELAY)}) AND regexp_matches(b.sentence, {_quoted(P.HALF)}) AND NOT contains(b.sentence, '{P.ONE_WAY}'))
SELECT doc_id, line_no, other_line, substring(sentence, 1, 80) AS sample, substring(other, 1, 80) AS other FROM p WHERE k = 1"""


def _quantities() -> str:
    p = _quoted("(?i)" + P.QUANTITY)
    found = _hits(_CONS, "(?i)" + P.QUANTITY)
    return f"""
WITH h AS (
  SELECT h.doc_id, regexp_extract(h.text, {p}, 1) || '|' || regexp_extract(h.text, {p}, 3) AS key, regexp_extract(h.text, {p}, 2) AS value, line_no,
    start, substring(d.text, greatest(0, start - {P.CONTEXT}) + 1, start + {P.CONTEXT} - greatest(0, start - {P.CONTEXT})) AS around, regexp_matches(around, {_quoted(P.PLACEHOLDER)}) AS example
  FROM ({found}) h JOIN {_CONS} d ON d.doc_id = h.doc_id)
SELECT doc_id, key, string_agg(DISTINCT value, ', ' ORDER BY value) AS values, min(line_no) AS first_line, count(*) AS n,
  array_to_string(list(substring(replace(around, chr(10), ' '), 1, 100) ORDER BY start)[1:3], ' | ') AS samples FROM h
GROUP BY doc_id, key HAVING count(DISTINCT value) > 1 AND NOT bool_or(example)"""


def _leaks() -> str:
    return f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(hexes[1:3], ',') AS hexes, substring({_TRIM.format('raw')}, 1, 90) AS sample FROM (
  SELECT *, regexp_extract_all(near, {_quoted(P.HEX)}) AS hexes FROM (
    SELECT *, string_agg(raw, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 6 FOLLOWING) AS near FROM ({_lines(_CONS)})))
WHERE regexp_matches(raw, {_quoted(P.PLACEHOLDER)}) AND len(hexes) > 0"""


def _basis() -> str:
    return f"""
WITH s AS ({_sentences()}),
r AS (SELECT * FROM s WHERE regexp_matches(sentence, {_quoted('(?i)' + P.RELATIVE)})),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) AS k FROM s WHERE regexp_matches(sentence, {_quoted('(?i)' + P.ABSOLUTE)})),
x AS (
  SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) AS j FROM r
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = r.doc_id AND abs(a.line_no - r.line_no) <= {P.BASIS_REACH})
  AND EXISTS (SELECT 1 FROM a WHERE a.doc_id = r.doc_id AND k = 1 AND NOT contains(sentence, '区分') AND NOT contains(sentence, '相对')))
SELECT doc_id, line_no, substring(sentence, 1, 80) AS sample FROM x WHERE j = 1"""


def _consistency() -> str:
    return f"""
SELECT doc_id, '时延表述矛盾' AS rule, 'high' AS level, line_no, sample FROM ({_delay()})
UNION ALL SELECT doc_id, '同一量多值', 'medium', first_line, key || ': ' || values FROM ({_quantities()})
UNION ALL SELECT doc_id, '占位值泄露', 'medium', line_no, sample FROM ({_leaks()})
UNION ALL SELECT doc_id, '序号基准混用', 'low', line_no, sample FROM ({_basis()})"""


def _versions(docs: str) -> str:
    return f"""
SELECT doc_id, key, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all({_MASKED}, {_quoted(P.VERSION)})) AS key FROM {docs})
WHERE NOT regexp_matches(key, '^\\d{{4}}\\.\\d') AND NOT regexp_matches(key, '^\\d\\.\\d$') AND len(list_filter(string_split(key, '.'), lambda x: length(x) > 4)) = 0 GROUP BY doc_id, key"""


def _numbers(docs: str) -> str:
    p = _quoted(P.NUMBER)
    return f"""
SELECT doc_id, key, count(*) AS cnt FROM (
  SELECT doc_id, unnest(list_transform(list_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2)), lambda x: x[1] || ' ' || x[2])) AS key FROM {docs}) GROUP BY doc_id, key"""


def _doc_terms(docs: str) -> str:
    body = f"(SELECT doc_id, {_MASKED} AS text FROM (SELECT doc_id, {_NO_CODE} AS text FROM {docs}))"
    return f"SELECT doc_id, key, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(P.TERM)})) AS key FROM {body}) GROUP BY doc_id, key HAVING count(*) >= 2"


def _blocks(docs: str, fences: bool) -> str:
    """Lines with the start of the table that they are in."""
    code = "(is_fence OR fences % 2 = 1)" if fences else "false"
    return f"""
SELECT *, CASE WHEN piped THEN min(CASE WHEN head THEN line_no END) OVER (PARTITION BY doc_id, run, piped ORDER BY line_no) END AS start_line FROM (
  SELECT *, sum(CAST(NOT piped AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run,
    piped AND coalesce(lead(rule AND NOT code) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS head FROM (
    SELECT *, {code} AS code, starts_with(stripped, '|') AND NOT {code} AS piped, regexp_matches(stripped, {_quoted(P.TABLE_RULE)}) AS rule FROM ({_lines(docs)})))"""


_CELLS = "list_transform(string_split(trim(stripped, '|'), '|'), lambda x: trim(x))"


def _modules() -> str:
    return f"""
WITH t AS (SELECT * FROM ({_blocks(_FACTS, False)}) WHERE start_line IS NOT NULL),
f AS (SELECT doc_id, min(start_line) AS start_line FROM t GROUP BY doc_id)
SELECT DISTINCT doc_id, {_CELLS}[1] AS module FROM t JOIN f USING (doc_id, start_line) WHERE line_no - start_line >= 2"""


def _tables() -> str:
    return f"""
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(row_number() OVER (PARTITION BY doc_id, start_line ORDER BY line_no) AS INTEGER) AS row_no, array_to_string({_CELLS}, chr(31)) AS cells
FROM ({_blocks(_MD, True)}) WHERE start_line IS NOT NULL AND NOT rule"""


def _events() -> str:
    return rf"""
WITH b AS (SELECT *, fences % 2 = 1 AS in_code FROM ({_blocks(_MD, True)}) WHERE NOT is_fence AND (fences % 2 = 1 OR stripped NOT IN ('', '---'))),
k AS (SELECT *, coalesce(start_line, line_no) AS place, CASE WHEN in_code THEN 'code' WHEN start_line IS NOT NULL THEN 'table'
    WHEN regexp_matches(stripped, '^(#{{1,6}})\s+(.*)$') THEN 'heading' WHEN regexp_matches(stripped, '^!\[(.*?)\]\((.*?)\)$') THEN 'image' WHEN starts_with(stripped, '>') THEN 'quote'
    WHEN regexp_matches(stripped, '^[-*•]\s+(.*)$') THEN 'bullet' WHEN regexp_matches(stripped, '^(\d+)[.、)]\s+(.*)$') THEN 'number' ELSE 'para' END AS kind FROM b),
t AS (SELECT *, CASE kind WHEN 'code' THEN raw WHEN 'table' THEN array_to_string({_CELLS}, chr(31)) WHEN 'heading' THEN regexp_extract(stripped, '^(#{{1,6}})\s+(.*)$', 2) WHEN 'image' THEN regexp_extract(stripped, '^!\[(.*?)\]\((.*?)\)$', 1)
    WHEN 'quote' THEN trim(ltrim(stripped, '>')) WHEN 'bullet' THEN regexp_extract(stripped, '^[-*•]\s+(.*)$', 1) WHEN 'number' THEN regexp_extract(stripped, '^(\d+)[.、)]\s+(.*)$', 2) ELSE stripped END AS body FROM k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS seq, CAST(place AS INTEGER) AS line_no, kind, level, text FROM (
  SELECT doc_id, place, kind, CAST(max(CASE WHEN kind = 'heading' THEN length(regexp_extract(stripped, '^#+')) ELSE 0 END) AS INTEGER) AS level,
    coalesce(string_agg(body, chr(10) ORDER BY line_no) FILTER (kind <> 'table' OR NOT rule), '') AS text FROM t GROUP BY doc_id, place, kind)"""


def _partial(facts: str, absent: bool) -> str:
    more = ", array_to_string(list_sort(list_filter(everyone, lambda x: NOT list_contains(ids, x))), ',') AS absent" if absent else ""
    return f"""
WITH s AS {_SETS}, z AS (SELECT doc_set_id, list(DISTINCT doc_id) AS everyone FROM s GROUP BY doc_set_id),
p AS (SELECT doc_set_id, key, list_sort(list(DISTINCT f.doc_id)) AS ids FROM ({facts}) f JOIN s USING (doc_id) GROUP BY doc_set_id, key)
SELECT doc_set_id, key, CAST(len(ids) AS INTEGER) AS n_present, len(everyone) AS "of", array_to_string(ids, ',') AS present{more}
FROM p JOIN z USING (doc_set_id) WHERE len(ids) < len(everyone)"""


def _cross_terms() -> str:
    return f"""
WITH s AS {_SETS}, t AS (SELECT doc_set_id, f.* FROM ({_doc_terms(_FACTS)}) f JOIN s USING (doc_id))
SELECT t.doc_set_id, t.doc_id, t.key, t.cnt, string_agg(s.doc_id, ',' ORDER BY s.doc_id) AS missing
FROM t JOIN s ON s.doc_set_id = t.doc_set_id AND NOT EXISTS (SELECT 1 FROM t u WHERE u.doc_set_id = t.doc_set_id AND u.doc_id = s.doc_id AND u.key = t.key)
WHERE t.cnt >= 3 GROUP BY ALL"""


def _cross_modules() -> str:
    less = lambda a, b: f"coalesce(array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ','), '')"
    return f"""
WITH s AS {_SETS}, m AS (SELECT doc_set_id, doc_id, list(module) AS ms FROM ({_modules()}) JOIN s USING (doc_id) GROUP BY doc_set_id, doc_id),
f AS (SELECT doc_set_id, arg_min(ms, doc_id) AS fs FROM m GROUP BY doc_set_id)
SELECT * FROM (SELECT doc_set_id, doc_id, {less('fs', 'ms')} AS missing, {less('ms', 'fs')} AS extra FROM m JOIN f USING (doc_set_id)) WHERE missing <> '' OR extra <> ''"""


def _signals() -> str:
    p = _quoted(P.NUMBER)
    return f"""
SELECT DISTINCT doc_set_id, op, kind, key FROM (
  SELECT doc_set_id, op, 'version' AS kind, unnest(regexp_extract_all(line, {_quoted(P.VERSION)})) AS key FROM l
  UNION ALL SELECT doc_set_id, op, 'number', unnest(list_transform(list_zip(regexp_extract_all(line, {p}, 1), regexp_extract_all(line, {p}, 2)), lambda x: x[1] || ' ' || x[2])) FROM l)"""


def _signal_lines() -> str:
    return f"""l AS (
  SELECT doc_set_id, CASE WHEN line[1] = '+' THEN 'added' ELSE 'removed' END AS op, substring(line, 2) AS line
  FROM (SELECT doc_set_id, unnest(string_split({X.DIFF}, chr(10))) AS line FROM (SELECT DISTINCT doc_set_id FROM {_SETS}))
  WHERE (starts_with(line, '+') AND NOT starts_with(line, '+++')) OR (starts_with(line, '-') AND NOT starts_with(line, '---')))"""


def _sync() -> str:
    return f"""
WITH {_signal_lines()}, g AS ({_signals()}),
x AS (SELECT doc_set_id, doc_id, CASE WHEN op = 'removed' AND contains(text, key) THEN 'stale' WHEN op = 'added' AND NOT contains(text, key) THEN 'missing' END AS finding, kind, key
  FROM g JOIN {_SETS} s USING (doc_set_id) JOIN {_FACTS} d USING (doc_id))
SELECT * FROM x WHERE finding IS NOT NULL"""


def _renumber(docs: str, kind: str, count: str, more: str = "") -> str:
    """``docs(doc_id, text, old)`` with references and captions of a kind renumbered."""
    p = _quoted(kind + r"\s*\d+")
    return rf"""
SELECT doc_id, CASE WHEN len(caps) > 0 THEN array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || CASE WHEN i > len(ms) THEN '' ELSE '{kind}' || CASE
    WHEN list_contains(caps, i) THEN CAST(list_position(caps, i) AS VARCHAR)
    WHEN len(list_filter(caps, lambda c: ns[c] = ns[i])) > 0 THEN CAST(list_position(caps, list_max(list_filter(caps, lambda c: ns[c] = ns[i]))) AS VARCHAR) ELSE ns[i] END END), '') ELSE text END AS text, old, CAST(len(caps) AS BIGINT) AS {count}{more}
FROM (SELECT *, list_filter(range(1, len(ms) + 1), lambda i: (ends_with(gs[i], chr(10)) OR (i = 1 AND gs[1] = '')) AND
    regexp_matches(array_to_string(list_transform(range(i, len(ms) + 1), lambda k: CASE WHEN k = i THEN gs[k + 1] ELSE ms[k] || gs[k + 1] END), ''), '^[^。！？
]{{0,{P.CAPTION_MOST}}}(
|$)')) AS caps
  FROM (SELECT *, list_transform(ms, lambda m: CAST(CAST(regexp_extract(m, '\d+') AS HUGEINT) AS VARCHAR)) AS ns
    FROM (SELECT *, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM {docs})))"""


def _resequence() -> str:
    figures = _renumber(f"(SELECT doc_id, text, text AS old FROM {_AUDIT})", P.FIGURE, "n_figures")
    return f"SELECT doc_id, text, text <> old AS changed, n_figures, n_tables FROM ({_renumber(f'({figures})', P.TABLE, 'n_tables', ', n_figures')})"


def _runs() -> str:
    p = _quoted(r"\*\*.+?\*\*|`[^`]+`|\*[^*]+?\*")
    return rf"""
WITH e AS (SELECT doc_id, seq, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM ({_events()}) WHERE kind = 'para'),
b AS (SELECT doc_id, seq, unnest(flatten(list_transform(range(1, len(gs) + 1), lambda i: [{{'k': 2 * i, 'style': 'plain', 'text': gs[i]}}, {{'k': 2 * i + 1, 'style': CASE WHEN starts_with(ms[i], '**') THEN 'bold' WHEN starts_with(ms[i], '`') THEN 'code' ELSE 'italic' END,
  'text': CASE WHEN starts_with(ms[i], '**') THEN substring(ms[i], 3, length(ms[i]) - 4) ELSE substring(ms[i], 2, length(ms[i]) - 2) END}}]))) AS r FROM e)
SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id, seq ORDER BY r.k) - 1 AS INTEGER) AS run_no, r.style AS style, r.text AS text FROM b WHERE r.text IS NOT NULL AND (r.style <> 'plain' OR r.text <> '')"""


def _tree() -> str:
    """Files of the source tree that are kept."""
    names = lambda x: "(" + ", ".join(map(_quoted, x)) + ")"
    noise = " OR ".join([f"d IN {names(P.NOISE_FOLDERS)}", *(f"starts_with(d, {_quoted(x)})" for x in P.NOISE_PREFIXES)])
    ends = " OR ".join(f"ends_with(path, {_quoted(x)})" for x in P.NOISE_ENDS)
    bare = " OR ".join(f"starts_with(name, {_quoted(x)})" for x in P.BARE_NAMES)
    out = " OR ".join(f"path = {_quoted(x)} OR starts_with(path, {_quoted(x + '/')})" for x in X.EXCLUDED)
    return f"""
SELECT path, text FROM (SELECT path, text, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM (SELECT {X.TREE} AS path, coalesce(text, '') AS text FROM documents))
WHERE len(list_filter(parts[1:len(parts) - 1], lambda d: {noise})) = 0 AND NOT ({ends}) AND NOT ({out})
  AND CASE WHEN regexp_matches(name, '^.+[.][^.]+$') THEN lower(regexp_extract(name, '[.]([^.]+)$', 1)) IN {names(P.CODE_EXTENSIONS)} ELSE {bare} END"""


_LISTED = "(SELECT path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM ({0}))"
_N_LINES = "CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'), '(^|[^*])\\*([^*]+)\\*($|[^*])', '\\1\\2\\3', 'g')"


def _office(events: str) -> str:
    """What is read back from office documents of events."""
    text = f"CASE WHEN kind = 'code' THEN text WHEN kind = 'image' THEN '' ELSE {_PLAIN} END"
    return f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS seq, CASE WHEN kind = 'quote' THEN 'para' ELSE kind END AS kind, CAST(CASE WHEN kind = 'heading' THEN least(level, 4) ELSE 0 END AS INTEGER) AS level, {text} AS text FROM ({events})"""


def _compared(left: str, right: str) -> str:
    """Both streams walked step by step: an image on the left waits for one on the right."""
    clean = f"regexp_replace({_PLAIN}, '\\s+', '', 'g')"
    side = lambda sql: f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, kind, level, {clean} AS clean, CASE WHEN kind = 'table' THEN list_transform(string_split(text, chr(10)), lambda r: len(string_split(r, chr(31)))) END AS columns FROM ({sql})"
    return f"""
WITH RECURSIVE a AS MATERIALIZED ({side(left)}), b AS MATERIALIZED ({side(right)}),
w AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS j FROM (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b)
  UNION ALL SELECT w.doc_id, CASE WHEN a.kind = 'image' AND b.kind <> 'image' THEN w.i ELSE w.i + 1 END, w.j + 1 FROM w JOIN a ON a.doc_id = w.doc_id AND a.seq = w.i JOIN b ON b.doc_id = w.doc_id AND b.seq = w.j),
s AS (SELECT w.doc_id, i, j, a AS x, b AS y FROM w JOIN a ON a.doc_id = w.doc_id AND a.seq = w.i JOIN b ON b.doc_id = w.doc_id AND b.seq = w.j),
e AS (SELECT doc_id, max(i) AS i, max(j) AS j FROM w GROUP BY doc_id),
p AS (
  SELECT doc_id, i AS left_seq, j AS right_seq, 0 AS rank, ['image missing'] AS found FROM s WHERE x.kind = 'image' AND y.kind <> 'image'
  UNION ALL SELECT doc_id, i, j, 2, CASE WHEN x.kind = 'quote' AND y.kind = 'para' THEN [] WHEN x.kind <> y.kind THEN ['kind']
    WHEN x.kind = 'table' THEN CASE WHEN len(x.columns) <> len(y.columns) THEN ['table rows'] ELSE [] END
      || list_transform(list_filter(range(1, least(len(x.columns), len(y.columns)) + 1), lambda k: x.columns[k] <> y.columns[k]), lambda k: 'table columns') || CASE WHEN x.clean <> y.clean THEN ['table cells'] ELSE [] END
    ELSE CASE WHEN x.kind = 'heading' AND x.level <> y.level THEN ['level'] ELSE [] END || CASE WHEN x.clean <> y.clean THEN ['text'] ELSE [] END END FROM s WHERE x.kind <> 'image'
  UNION ALL SELECT a.doc_id, a.seq, -1, 1, ['left over'] FROM a JOIN e ON e.doc_id = a.doc_id AND a.seq >= e.i
  UNION ALL SELECT b.doc_id, -1, b.seq, 0, ['added'] FROM b JOIN e ON e.doc_id = b.doc_id AND b.seq >= e.j),
u AS (SELECT doc_id, left_seq, right_seq, rank, unnest(found) AS problem, unnest(range(len(found))) AS k FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY left_seq < 0, left_seq, rank, k, right_seq) - 1 AS INTEGER) AS seq, problem, CAST(left_seq AS INTEGER) AS left_seq, CAST(right_seq AS INTEGER) AS right_seq FROM u"""


def _version_diff() -> str:
    """What was done to each line; the lines are distinct, so no other alignment is longer."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM {_RAW}),
n AS (SELECT doc_id, i, (i + 1) || ' ' || x AS x, (doc_id + i) % 11 = 0 AS gone, (doc_id + i) % 13 = 0 AS other, (doc_id + i) % 17 = 0 AS more FROM l),
p AS (SELECT *, unnest(CASE WHEN gone THEN [] WHEN other THEN ['changed'] WHEN more THEN ['same', 'inserted'] ELSE ['same'] END) AS state FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, state DESC) AS new_line FROM p)
SELECT doc_id, 'removed' AS op, CAST(i + 1 AS INTEGER) AS old_line, 0 AS new_line, x AS line FROM n WHERE gone OR other
UNION ALL SELECT doc_id, 'added', 0, CAST(new_line AS INTEGER), CASE state WHEN 'changed' THEN x || ' v2.' || i || '.0 of 10 MB' ELSE 'inserted ' || i || ' 3.1.4' END FROM w WHERE state <> 'same'"""


def _version_sync() -> str:
    return f"""
WITH x AS (SELECT {X.SET_OF} AS doc_set_id, unnest(string_split(text, chr(10))) AS line FROM {_FACTS} WHERE doc_id % 3 = 0),
y AS (SELECT *, replace(replace(line, 'v2.1.0', 'v2.0.9'), '20MB', '25 MB') AS before FROM x),
l AS (SELECT doc_set_id, 'added' AS op, line FROM y WHERE line <> before UNION ALL SELECT doc_set_id, 'removed', before FROM y WHERE line <> before),
g AS ({_signals()}),
f AS (SELECT doc_set_id, doc_id, CASE WHEN op = 'removed' AND contains(text, key) THEN 'stale' WHEN op = 'added' AND NOT contains(text, key) THEN 'missing' END AS finding, kind, key
  FROM g JOIN {_SETS} s USING (doc_set_id) JOIN {_FACTS} d USING (doc_id) WHERE doc_id % 3 <> 0)
SELECT * FROM f WHERE finding IS NOT NULL"""


_PLACES = ("x", "y", "width", "height", "bend_x", "to_x", "to_y", "label_x", "label_y", "note_x", "note_y")


def _placed(part: str, seq: str, shape: str, label: str, source: str, **places: str) -> str:
    columns = ", ".join(f"CAST({places.get(p, 'NULL')} AS DOUBLE) AS {p}" for p in _PLACES)
    return f"SELECT diagram_id, {part} AS part, CAST({seq} AS INTEGER) AS seq, {shape} AS shape, {label} AS label, {columns} FROM {source}"


def _flows() -> str:
    side = lambda a, b: f"CASE WHEN side THEN {a} ELSE {b} END"
    labelled = lambda c: f"CASE WHEN label IS NOT NULL THEN {c} END"
    return f"""
WITH n AS (
  SELECT doc_id AS diagram_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM {_RAW}),
k AS (SELECT *, CASE WHEN i = 0 THEN 'start' WHEN i = n - 1 THEN 'end' WHEN ends_with(text, '?') THEN 'decision' ELSE 'process' END AS kind FROM n),
e AS (
  SELECT diagram_id, 4 * i AS seq, i AS a, i + 1 AS z, NULL AS label FROM n WHERE i + 1 < n
  UNION ALL SELECT diagram_id, 4 * i + 1, i, i - 3, 'again' FROM n WHERE i % 7 = 3
  UNION ALL SELECT diagram_id, 4 * i + 2, i, i + 4, 'skip' FROM n WHERE i % 11 = 5 AND i + 4 < n),
s AS (SELECT *, abs(a - z) > 1 AS side, 650 - 46 * (sum(CAST(abs(a - z) > 1 AS INTEGER)) OVER (PARTITION BY diagram_id ORDER BY seq) - 1) AS bend, 90 + 110 * a AS ya, 90 + 110 * z AS yz FROM e)
{_placed("'node'", "i", "CASE WHEN kind IN ('start', 'end') THEN 'rounded' WHEN kind = 'decision' THEN 'diamond' ELSE 'box' END", "text", "k", x="380", y="90 + 110 * i", width="CASE WHEN kind = 'decision' THEN 300 ELSE 320 END", height="30 + 22 * (1 + (length(text) - length(replace(text, chr(92) || 'n', ''))) // 2)")}
UNION ALL {_placed("'edge'", "seq", side("'side'", "'straight'"), "label", "s", x=side("540", "380"), y=side("ya", "ya + 32"), bend_x=side("bend", "NULL"), to_x=side("540", "380"), to_y=side("yz", "yz - 32"), label_x=labelled(side("bend - 12", "406")), label_y=labelled(side("ya", "(ya + yz) / 2")))}
UNION ALL {_placed("'unknown'", "3", "'none'", "'nowhere'", "(SELECT doc_id AS diagram_id FROM documents WHERE doc_id % 9 = 0)")}"""


def _sequences() -> str:
    messages = "array_to_string(list_transform(range(len(ls)), lambda i: '{\"from\": ' || i % 3 || ', \"to\": ' || (i + 1 + i % 2) % 3 || ', \"label\": \"L' || length(ls[i + 1]) || '\", \"note\": \"' || CASE WHEN i % 4 = 0 THEN 'noted' ELSE '' END || '\"}'), ', ')"
    shape = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {x.replace('MESSAGES', messages)}" for i, x in enumerate(X.DIAGRAMS)) + " END"
    end = lambda key: f"CASE WHEN json_type(m, '$.{key}') = 'VARCHAR' THEN list_position(names, m->>'$.{key}') - 1 WHEN CAST(m->>'$.{key}' AS INTEGER) < 0 THEN CAST(m->>'$.{key}' AS INTEGER) + n ELSE CAST(m->>'$.{key}' AS INTEGER) END"
    at = lambda i: f"40 + (w - 80) * ({i} + 0.5) / n"
    label = "concat_ws(chr(10), m->>'$.label', CASE WHEN coalesce(m->>'$.note', '') <> '' THEN m->>'$.note' END)"
    noted = lambda c: f"CASE WHEN coalesce(m->>'$.note', '') <> '' THEN {c} END"
    lost = lambda c, key: f"CASE WHEN {c} IS NULL OR {c} < 0 OR {c} >= n THEN m->>'$.{key}' END"
    return f"""
WITH c AS (SELECT doc_id AS diagram_id, {shape} AS config FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_RAW})),
j AS (SELECT diagram_id, CASE WHEN json_valid(config) THEN CAST(config AS JSON) END AS j FROM c),
t AS (SELECT diagram_id, j, j->>'$.type' AS type, CAST(j->'$.actors' AS VARCHAR[]) AS names, coalesce(json_array_length(j, '$.actors'), 0) AS n, CAST(coalesce(json_array_length(j, '$.messages'), 0) AS INTEGER) AS said, CAST(coalesce(j->>'$.width', '1000') AS DOUBLE) AS w FROM j),
g AS (SELECT * FROM t WHERE type = 'sequence' AND n > 0),
a AS (SELECT diagram_id, n, w, unnest(names) AS name, unnest(range(CAST(n AS BIGINT))) AS i FROM g),
m AS (SELECT diagram_id, n, w, names, unnest(CAST(j->'$.messages' AS JSON[])) AS m, unnest(range(said)) AS k FROM g),
e AS (SELECT *, {end('from')} AS a, {end('to')} AS z FROM m),
o AS (SELECT *, {lost('a', 'from')} AS la, {lost('z', 'to')} AS lz FROM e),
b AS (SELECT *, {at('a')} AS xa, {at('z')} AS xz, 130 + 95 * k AS y FROM o WHERE la IS NULL AND lz IS NULL)
{_placed("'frame'", "0", "'box'", "NULL", "g", x="0", y="0", width="w", height="170 + 95 * said")}
UNION ALL {_placed("'actor'", "i", "'box'", "name", "a", x=at("i"), y="50", width="150", height="46")}
UNION ALL {_placed("'message'", "k + 1", "CASE WHEN xz > xa THEN 'right' ELSE 'left' END", label, "b", x="xa", y="y", to_x="xz", to_y="y", label_x="(xa + xz) / 2", label_y="y - 16", note_x=noted("(xa + xz) / 2 + 40"), note_y=noted("y + 18"))}
UNION ALL {_placed("'unknown'", "k + 1", "'none'", "concat_ws(',', la, lz)", "o WHERE la IS NOT NULL OR lz IS NOT NULL")}
UNION ALL {_placed("CASE WHEN type IS NULL OR type = 'sequence' THEN 'invalid' ELSE 'unsupported' END", "0", "'none'", "type", "t WHERE type IS NULL OR (type = 'sequence' AND n = 0) OR type NOT IN ('sequence', 'flow')")}"""


def _captions() -> str:
    return rf"""
WITH b AS (SELECT *, fences % 2 = 1 AS in_code FROM ({_blocks(_docs(X.CAPTIONS), True)})),
k AS (SELECT *, is_fence OR in_code AS code, start_line IS NOT NULL AS tab, NOT is_fence AND NOT in_code AND start_line IS NULL AND regexp_matches(stripped, '^!\[(.*?)\]\((.*?)\)$') AS img
  FROM b WHERE is_fence OR in_code OR stripped NOT IN ('', '---')),
w AS (SELECT *, lag(CASE WHEN tab THEN 'table' WHEN img THEN 'image' END) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, stripped[1] AS kind, CAST(CAST(regexp_extract(stripped, '^[图表](\d+)', 1) AS HUGEINT) AS VARCHAR) AS number, stripped AS text, before AS "of"
FROM w WHERE before IS NOT NULL AND NOT code AND NOT tab AND regexp_matches(stripped, '^[图表]\d+')"""


def _image_sizes() -> str:
    kind = "CASE doc_id % 6 WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' WHEN 4 THEN 'jpeg' WHEN 5 THEN 'jpeg' ELSE 'png' END"
    return f"""
WITH s AS (SELECT doc_id, 'img/' || doc_id || '.' || {X._choice('doc_id', X._IMAGE_KINDS)} AS path, {kind} AS kind, CASE WHEN doc_id % 6 < 5 THEN {X.PIXELS[0]} ELSE 0 END AS width, CASE WHEN doc_id % 6 < 5 THEN {X.PIXELS[1]} ELSE 0 END AS height FROM {_RAW}),
r AS (SELECT *, CASE WHEN width > 0 THEN height / width END AS ratio FROM s)
SELECT path, kind, width, height, CASE WHEN ratio > CAST(22 AS DOUBLE) / CAST(14.5 AS DOUBLE) THEN CAST(22 AS DOUBLE) / ratio WHEN ratio IS NOT NULL THEN 14.5 END AS width_cm,
  CASE WHEN ratio > CAST(22 AS DOUBLE) / CAST(14.5 AS DOUBLE) THEN 22 ELSE CAST(14.5 AS DOUBLE) * ratio END AS height_cm,
  CASE doc_id % 6 WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 4 THEN 'image/webp' ELSE 'image/png' END AS mime FROM r"""


def _source_pages() -> str:
    return f"""
WITH f AS (SELECT path, {_N_LINES} AS n, string_split(text, chr(10)) AS ls FROM {_LISTED.format(_tree())}),
p AS (SELECT *, 1 + CAST(ceil((count(*) OVER () + 2) / 50) AS BIGINT) + coalesce(sum(CAST(ceil((n + 1) / 50) AS BIGINT)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_page FROM f),
l AS (
  SELECT path, 0 AS line_no, first_page, '文件：' || path || '（' || n || ' 行）' AS line FROM p
  UNION ALL SELECT path, unnest(range(1, n + 1)), first_page, rtrim(unnest(ls[1:n]), ' ') FROM p)
SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(first_page + line_no // 50 AS BIGINT) AS page, CAST(line_no % 50 + 1 AS INTEGER) AS place, line FROM l"""


def _retention() -> str:
    return rf"""
WITH a AS (SELECT source || '/' || doc_id % 40 AS category, {X.TEMPLATE} AS name FROM documents),
d AS (SELECT *, TRY_CAST(nullif(regexp_extract(name, '^(\d{{4}}-\d{{2}}-\d{{2}})-(\d{{2,}})-(.+)\.md$', 1), '') AS DATE) AS stored_on, TRY_CAST(nullif(regexp_extract(name, '^(\d{{4}}-\d{{2}}-\d{{2}})-(\d{{2,}})-(.+)\.md$', 2), '') AS BIGINT) AS number FROM a),
r AS (SELECT *, CASE WHEN stored_on IS NOT NULL THEN row_number() OVER (PARTITION BY category, stored_on IS NULL ORDER BY stored_on DESC, number DESC, name DESC) END AS k, count(stored_on) OVER (PARTITION BY category) AS n FROM d)
SELECT category, name, coalesce(CAST(stored_on AS VARCHAR), '') AS stored_on, coalesce(number, 0) AS number, CAST(CASE WHEN k <= 10 THEN k ELSE 0 END AS INTEGER) AS place, coalesce(k <= 10, true) AS kept, n >= 3 AS consensus FROM r"""


def _choice() -> str:
    return f"""
WITH q AS (SELECT doc_id AS request_id, source || '/' || doc_id % 60 AS category, lang || doc_id % 50 AS topic FROM documents),
o AS (SELECT lang || doc_id % 50 AS topic, min(lang || doc_id || '.md') AS own FROM documents WHERE doc_id % 50 < 5 GROUP BY ALL),
c AS (SELECT DISTINCT category FROM ({_retention()}) WHERE consensus),
b AS (SELECT source || '/' || doc_id % 60 AS category, min(source || '.md') AS given FROM documents WHERE doc_id % 60 >= 50 AND doc_id % 2 = 0 GROUP BY ALL)
SELECT request_id, q.category, q.topic, CASE WHEN own IS NOT NULL THEN 1 WHEN c.category IS NOT NULL THEN 2 WHEN given IS NOT NULL THEN 3 ELSE 0 END AS tier, coalesce(own, CASE WHEN c.category IS NOT NULL THEN 'consensus' END, given) AS template
FROM q LEFT JOIN o USING (topic) LEFT JOIN c ON c.category = q.category LEFT JOIN b ON b.category = q.category"""


def _verify_report(problems: str) -> str:
    return f"""
SELECT doc_id, count(*) AS total, string_agg(problem || ' ' || left_seq || ' / ' || right_seq, chr(10) ORDER BY seq) FILTER (seq < 20) AS items FROM ({problems}) GROUP BY doc_id"""


def _notes() -> str:
    body = "g = 'body'"
    return rf"""
WITH e AS (SELECT doc_id, kind, {_TRIM.format("text")} AS t FROM ({_office(_events())})),
p AS (SELECT *, CASE WHEN kind IN ('image', 'table') OR t = '' THEN 'empty' WHEN kind = 'heading' THEN 'heading' WHEN length(t) <= 40 AND regexp_matches(t, '^(图|表)\s*\d+') THEN 'caption'
  WHEN kind IN ('bullet', 'number') THEN 'list' WHEN kind = 'code' THEN 'code' WHEN starts_with(t, '>') THEN 'other' ELSE 'body' END AS g FROM e),
r AS (
  SELECT doc_id, 'group' AS what, g AS value FROM p WHERE kind <> 'table'
  UNION ALL SELECT doc_id, unnest(['indent', 'spacing', 'font', 'size']), unnest(['', '', '宋体', '12.0']) FROM p WHERE kind <> 'table' AND {body}
  UNION ALL SELECT doc_id, kind, '' FROM p WHERE kind IN ('table', 'image'))
SELECT doc_id, what, value, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT DISTINCT doc_id, 'widest image', '10.00', 1 FROM p WHERE kind = 'image'"""


def oracle_sql() -> dict[str, str]:
    verified = _compared(_events(), _office(f"SELECT doc_id, seq, kind, {X.EDIT_LEVEL} AS level, {X.EDIT_TEXT} AS text FROM ({_events()}) WHERE NOT ({X.EDIT_GONE})"))
    plain = f"regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'), '(^|[^*])\\*([^*]+)\\*($|[^*])', '\\1\\2\\3', 'g')"
    return {
        "scan_documents": f"SELECT doc_id, length(text) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM {_RAW}",
        "doc_lines": f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(raw) AS INTEGER) AS n_chars, is_fence, fences % 2 = 1 AS in_code FROM ({_lines(_AUDIT)})",
        "regex_hits": f"SELECT doc_id, start, line_no, text FROM ({_hits(_RAW, P.TERM, _MASKED)})",
        "doc_versions": _versions(_RAW),
        "doc_terms": _doc_terms(_RAW),
        "detect_language": f"SELECT doc_id, {_LANG} AS language FROM {_AUDIT}",
        "strip_code": f"SELECT doc_id, {_NO_CODE} AS body FROM {_AUDIT}",
        "strip_inline": f"SELECT doc_id, {plain} AS plain FROM {_MD}",
        "ai_flavor_hits": _ai(),
        "filler_hits": _filler(),
        "figure_table_gaps": _gaps(),
        "quote_issues": _quotes(),
        "empty_talk_issues": _empty(),
        "term_variants": _terms(),
        "code_fence_issues": _fences(),
        "section_jumps": _sections(),
        "audit_report": _report(),
        "audit_score": f"SELECT doc_id, score FROM ({_report()})",
        "doc_sentences": _sentences(),
        "check_delay": _delay(),
        "check_quantities": _quantities(),
        "check_placeholder_leak": _leaks(),
        "check_sequence_basis": _basis(),
        "consistency_hits": _consistency(),
        "doc_numbers": _numbers(_FACTS),
        "doc_modules": _modules(),
        "cross_versions": _partial(_versions(_FACTS), True),
        "cross_numbers": _partial(_numbers(_FACTS), False),
        "cross_terms": _cross_terms(),
        "cross_modules": _cross_modules(),
        "sync_signals": f"WITH {_signal_lines()} {_signals()}",
        "sync_check": _sync(),
        "consistency_report": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['high', 'medium', 'low'], level), rule, line_no, sample) AS INTEGER) AS place, level, rule, line_no, sample FROM ({_consistency()})",
        "cross_term_ranks": f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_set_id, doc_id ORDER BY cnt DESC, key) AS INTEGER) AS place FROM ({_cross_terms()})",
        "audit_sections": _audit_sections(),
        "md_tables": _tables(),
        "resequence": _resequence(),
        "inline_runs": _runs(),
        "source_files": f"SELECT path, octet_length(encode(text)) AS length FROM ({_tree()})",
        "source_line_counts": f"SELECT path, {_N_LINES} AS n_lines FROM {_LISTED.format(_tree())}",
        "source_summary": f"SELECT count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n) // 50 + count(*) // 3 + 3 AS BIGINT) AS pages FROM (SELECT {_N_LINES} AS n FROM {_LISTED.format(_tree())})",
        "source_listing": f"SELECT path, CAST(unnest(range(1, n + 1)) AS INTEGER) AS line_no, rtrim(unnest(ls[1:n]), ' ') AS line FROM (SELECT path, {_N_LINES} AS n, string_split(text, chr(10)) AS ls FROM {_LISTED.format(_tree())})",
        "md_events": _events(),
        "docx_events": _office(_events()),
        "docx_verify": verified,
        "docx_format_notes": _notes(),
        "verify_report": _verify_report(verified),
        "compare_events": _compared(_events(), f"SELECT doc_id, seq, CASE WHEN kind = 'bullet' THEN 'para' ELSE kind END AS kind, level, text FROM ({_events()}) WHERE kind <> 'image'"),
        "version_diff": _version_diff(),
        "version_sync": _version_sync(),
        "flow_layout": _flows(),
        "sequence_layout": _sequences(),
        "md_captions": _captions(),
        "image_sizes": _image_sizes(),
        "source_pages": _source_pages(),
        "template_retention": _retention(),
        "template_choice": _choice(),
        "md_event_counts": f"SELECT doc_id, kind, count(*) AS n FROM ({_events()}) GROUP BY doc_id, kind",
    }
