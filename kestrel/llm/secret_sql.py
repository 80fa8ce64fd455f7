"""The secret scan as DuckDB SQL, for comparison with the Spark query."""

from __future__ import annotations

from kestrel.llm.secret_scan import ACCESS, ADDED, ASSIGN, HEX, NAMES_SHARE, SAMPLE_TOKEN, TOKEN_CLASS, UUID, numbered_names


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ascii_case(pattern: str) -> str:
    """The pattern with its case-insensitive part spelled out for ASCII letters only."""
    begin = pattern.index("(?i:") + 4
    end = pattern.index("))") + 1
    part = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern[begin:end])
    return pattern[:begin - 4] + part + pattern[end + 1:]


def _located(name: str, source: str, pattern: str, group: int = 0) -> str:
    """CTEs ``name`` (doc_id, found, value, stop, k) and ``name_rest`` (doc_id, t: the text with matches blanked)."""
    p = _quoted(pattern)
    return f"""{name}_a AS (SELECT doc_id, regexp_extract_all(t, {p}) AS f, regexp_extract_all(t, {p}, {group}) AS v,
  string_split_regex(t, {p}) AS p FROM {source} WHERE regexp_matches(t, {p})),
{name}_r AS (SELECT doc_id, unnest(f) AS found, unnest(v) AS value, unnest(p[1:len(f)]) AS piece, generate_subscripts(f, 1) AS k, p[len(p)] AS last
  FROM {name}_a),
{name} AS (SELECT doc_id, found, value, k, CAST(sum(length(piece) + length(found)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM {name}_r),
{name}_b AS (SELECT doc_id, string_agg(piece || repeat(' ', length(found)), '' ORDER BY k) || any_value(last) AS t FROM {name}_r GROUP BY doc_id),
{name}_rest AS (SELECT s.doc_id, coalesce(b.t, s.t) AS t FROM {source} s LEFT JOIN {name}_b b USING (doc_id))"""


def scan_sql(min_token: int = SAMPLE_TOKEN, prior: float = 0.001) -> str:
    assign = _ascii_case(ASSIGN)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_located('assign', 'd', assign, 2)},
{_located('access', 'd', ACCESS)},
{_located('hex', 'd', HEX)},
{_located('access2', 'assign_rest', ACCESS)},
{_located('hex2', 'access2_rest', HEX)},
base AS (
  SELECT doc_id, 0 AS nth, 'assign' AS kind, stop - length(found) AS start, stop, value FROM assign WHERE length(value) >= 12
  UNION ALL SELECT doc_id, 1, 'access', stop - length(found), stop, found FROM access
  UNION ALL SELECT doc_id, 2, 'hex', stop - length(found), stop, found FROM hex),
sample AS (
  SELECT DISTINCT 1 AS label, value AS token, 1 AS w FROM base
  UNION ALL SELECT 0, token, length(bin(count(*))) - CASE WHEN regexp_matches(token, '[0-9]') THEN 1 ELSE 0 END
  FROM (SELECT unnest(regexp_extract_all(t, '{TOKEN_CLASS}{{{SAMPLE_TOKEN},}}')) AS token FROM hex2_rest) GROUP BY token),
pairs AS (
  SELECT label, w, substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b FROM
  (SELECT label, token, w, unnest(range(1, length(token))) AS i FROM sample WHERE w > 0)),
found AS (SELECT label, a, b, sum(w) AS n FROM pairs GROUP BY ALL),
names AS (SELECT unnest([{", ".join(f"'{x}'" for x in numbered_names())}]) AS token),
made AS (SELECT substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b, count(*) AS n
  FROM (SELECT token, unnest(range(1, length(token))) AS i FROM names) GROUP BY ALL),
share AS (SELECT greatest(1, (SELECT sum(n) FROM found WHERE label = 0) // ({NAMES_SHARE} * (SELECT sum(n) FROM made))) AS w),
n AS (SELECT label, a, b, sum(n) AS n FROM (SELECT * FROM found UNION ALL SELECT 0, a, b, n * w FROM made, share
  WHERE (SELECT count(*) FROM found WHERE label = 0) > 0) GROUP BY ALL),
chars AS (SELECT DISTINCT c FROM (SELECT a AS c FROM n UNION ALL SELECT b FROM n)),
size AS (SELECT count(*) AS size FROM chars),
labels AS (SELECT label, sum(n) AS total FROM n GROUP BY label),
single AS (
  SELECT l.label, c.c, (coalesce(sum(n.n), 0) + 1) / (l.total + size) AS share FROM labels l CROSS JOIN chars c CROSS JOIN size
  LEFT JOIN n ON n.label = l.label AND n.b = c.c GROUP BY l.label, c.c, l.total, size),
firsts AS (SELECT l.label, c.c, coalesce(sum(n.n), 0) AS total FROM labels l CROSS JOIN chars c LEFT JOIN n ON n.label = l.label AND n.a = c.c
  GROUP BY l.label, c.c),
p AS (
  SELECT f.label, f.c AS a, s.c AS b, (coalesce(n.n, 0) + size * s.share) / (f.total + size) AS p
  FROM firsts f JOIN single s ON s.label = f.label CROSS JOIN size LEFT JOIN n ON n.label = f.label AND n.a = f.c AND n.b = s.c),
ratio AS (SELECT x.a, x.b, ln(x.p / y.p) AS ratio FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND x.label = 1 AND y.label = 0),
{_located('token', 'hex2_rest', TOKEN_CLASS + '{%d,}' % min_token)},
steps AS (SELECT doc_id, k, found, stop, unnest(range(1, length(found))) AS i FROM token),
scored AS (
  SELECT s.doc_id, s.found, s.stop - length(s.found) AS start, s.stop, sum(coalesce(r.ratio, 0)) AS odds FROM steps s
  LEFT JOIN ratio r ON r.a = substr(s.found, s.i, 1) AND r.b = substr(s.found, s.i + 1, 1) GROUP BY s.doc_id, s.k, s.found, s.stop),
spans AS (
  SELECT doc_id, nth, kind, start, stop FROM base
  UNION ALL SELECT doc_id, 3, '{ADDED}', start, stop FROM scored WHERE NOT regexp_matches(found, '{UUID}') AND odds + ln({prior} / (1 - {prior})) > 0 AND (SELECT count(*) FROM labels) = 2),
shown AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, nth) FILTER (WHERE nth < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, nth), '') AS spans
FROM d LEFT JOIN shown USING (doc_id) GROUP BY d.doc_id"""
