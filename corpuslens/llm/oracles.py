"""SQL of the corpus operators that is made from their rules or parameters."""

from __future__ import annotations

from .centroids import CENTROIDS, DIMENSIONS, ROUNDS, SCALE
from .license_scan import PHRASE_SCORE, rule_table

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def license_sql() -> str:
    """Every rule in every text that holds its keyword; an interval stays unless another rule's contains it."""
    rules = ",\n    ".join("(" + ", ".join(_quoted(v) for v in r.values()) + ")" for r in rule_table())
    return rf"""
WITH rules(no, label, priority, score, pattern, keyword, phrase) AS (VALUES
    {rules}),
t AS (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS w
  FROM (SELECT doc_id, trim(regexp_replace({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS w FROM documents)),
hit AS (
  SELECT id, rules.*, string_split_regex(w, pattern) AS gaps, regexp_extract_all(w, pattern) AS found FROM t JOIN rules ON contains(w, keyword)),
p AS (SELECT * EXCLUDE (gaps, found), unnest(gaps) AS gap, unnest(found) AS m, unnest(range(len(gaps))) AS nth FROM hit WHERE len(found) > 0),
q AS (SELECT *, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS g, coalesce((length(m) - length(replace(m, ' ', ''))) // 2, 0) AS size FROM p),
placed AS (SELECT *, sum(g + size) OVER (PARTITION BY id, no ORDER BY nth) AS after FROM q),
f AS (SELECT id, no, label, priority, score, phrase, after - size AS first, after FROM placed WHERE m IS NOT NULL),
kept AS (
  SELECT * FROM f a WHERE NOT EXISTS (
    SELECT 1 FROM f b WHERE b.id = a.id AND b.priority >= a.priority AND b.first <= a.first AND b.after >= a.after
      AND (b.first < a.first OR b.after > a.after OR b.priority > a.priority OR b.no < a.no))),
l AS (
  SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (
    SELECT id, label, score FROM kept UNION ALL SELECT id, phrase, {PHRASE_SCORE} FROM f WHERE phrase IS NOT NULL) GROUP BY id),
b AS (
  SELECT id, count(*) AS n_base, CAST(min(first) AS BIGINT) AS first_word, CAST(max(first) AS BIGINT) AS last_word, string_agg(DISTINCT phrase, ',' ORDER BY phrase) AS base_labels
  FROM f WHERE phrase IS NOT NULL GROUP BY id)
SELECT doc_id, CAST((length(w) - length(replace(w, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN b USING (id) LEFT JOIN l USING (id)
"""


def cluster_sql() -> str:
    """All distances from all centroids, round by round."""
    floor = "CAST(CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END AS BIGINT)"
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k, x AS c FROM kept ORDER BY k LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        apart = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS b FROM (SELECT id, vec_id, x, k, CAST({apart} AS BIGINT) AS d FROM kept, c{i}) GROUP BY id)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT b.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(j) GROUP BY b.k, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list({floor} ORDER BY j) AS m FROM s{i} GROUP BY k) USING (k))")
    done = f"a{ROUNDS}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM {done} JOIN c{ROUNDS} ON c{ROUNDS}.k = {done}.b.k
"""


OP11_SQL, OP12_SQL = license_sql(), cluster_sql()

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 5) t(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS cnt FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(cnt) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, cnt AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND cnt >= 30),
held AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, k, unnest(range(1, m - k + 2)) AS i FROM c, range(2, 4) t(k) WHERE k < m) GROUP BY lang, phrase),
left_over AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (
  SELECT x.lang, x.phrase, x.a, x.k, l.cnt AS l, r.cnt AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.cnt + r.cnt) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM left_over) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.k + 1:], ' ')),
best AS (SELECT lang, phrase, a, unnest(min({{'score': score, 'k': k, 'l': l, 'r': r}})) FROM cuts GROUP BY lang, phrase, a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
