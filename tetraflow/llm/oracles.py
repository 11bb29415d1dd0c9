"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS = f"""
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)
"""

OP2 = f"""
WITH {_WORDS},
win AS (SELECT r, i, list_aggregate(list_slice(w, i, i + 34), 'string_agg', ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) u),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) u WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
pos AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s FROM pos ANTI JOIN gone USING (r, p) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)
"""

OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS ln FROM d),
full_ AS (SELECT doc_id, x, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
win AS (SELECT a.doc_id, a.i, a.x AS x1, b.x AS x2, a.ln AS p, b.ln AS q FROM full_ a JOIN full_ b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
late AS (SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY x1, x2 ORDER BY doc_id, i) AS k FROM win) u WHERE k > 1),
alone AS (SELECT doc_id, ln FROM (SELECT doc_id, ln, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM full_ WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 5) u WHERE k > 1),
gone AS (SELECT doc_id, p AS ln FROM late UNION SELECT doc_id, q FROM late UNION SELECT doc_id, ln FROM alone),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY ln) AS s FROM lines ANTI JOIN gone USING (doc_id, ln) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS s FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_deleted, coalesce(cut.s, '') AS deleted,
  sha256(CASE WHEN cut.n IS NULL THEN text ELSE coalesce(kept.s, '') END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

OP8 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[a-z0-9\x{{C0}}-\x{{1FFF}}\x{{2070}}-\x{{2FFF}}\x{{3040}}-\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[a-z0-9\x{{C0}}-\x{{1FFF}}\x{{2070}}-\x{{2FFF}}\x{{3040}}-\x{{10FFFF}}]+') AS w FROM benchmark),
si AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5) u),
sd AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5) u),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS k FROM sd JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, k AS n_shared, n AS n_shingles, k::DOUBLE / n AS containment FROM met JOIN n USING (item_id) WHERE k >= 0.8 * n
"""

OP9 = rf"""
WITH {_WORDS},
win AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) u),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) u WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM rep) u GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS full_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words,
  CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS BIGINT) AS n_letterless_words FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, CAST(len(full_lines) AS BIGINT) AS n_lines, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines FROM m),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN 2 * n_upper_words > n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_letterless_words > 3 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN 2 * word_chars < 5 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars > 12 * n_words THEN 128 ELSE 0 END) + (CASE WHEN n_words < 1 THEN 256 ELSE 0 END) AS INTEGER) AS failed_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits & 255 = 0 AS kept, n_lines, n_upper_words, n_letterless_words, failed_bits FROM f
"""

_RAW_VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)(\.[A-Za-z0-9]{1,5})?$"
_RAW_MIXED = r"^[A-Za-z0-9_~-]{16,}(\.[A-Za-z0-9]{1,5})?$"


def _levels(n: int) -> str:
    """One level of the template tree after the other; a parent with 24 children or more, none over a twentieth, has them all generalised."""
    out = ", t0 AS (SELECT host, raw, n, bad, labelled, '' AS template FROM tree)"
    for i in range(n):
        out += f"""
, c{i} AS (SELECT host, template, raw[{i + 1}] AS seg, sum(n) AS n FROM t{i} WHERE len(raw) > {i} GROUP BY host, template, raw[{i + 1}]),
o{i} AS (SELECT host, template FROM c{i} GROUP BY host, template HAVING count(*) >= 24 AND max(n) <= 0.05 * sum(n)),
t{i + 1} AS (SELECT t.host, raw, n, bad, labelled, CASE WHEN len(raw) > {i} THEN t.template || '/' || CASE WHEN o.host IS NOT NULL THEN '*' ELSE raw[{i + 1}] END ELSE t.template END AS template
  FROM t{i} t LEFT JOIN o{i} o ON o.host = t.host AND o.template = t.template)"""
    return out


_DEEPEST = 6
OP7 = (
    rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_A_Z}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM r),
s AS (SELECT *, list_transform(CASE WHEN len(segs) > 5 THEN list_append(list_slice(segs, 1, 5), '**') ELSE segs END, lambda s: CASE WHEN regexp_matches(s, '{_RAW_VARIABLE}') OR (regexp_matches(s, '{_RAW_MIXED}') AND regexp_matches(s, '[0-9]')) THEN '*' ELSE s END) AS raw FROM v),
tree AS (SELECT host, raw, count(*) AS n, count(*) FILTER (WHERE by_rule = 'block') AS bad, count(by_rule) AS labelled FROM s GROUP BY host, raw)
"""
    + _levels(_DEEPEST)
    + rf"""
, leaf AS (SELECT host, template, sum(bad) AS bad, sum(labelled) AS labelled, regexp_extract(template, '^(.*)/[^/]*$', 1) AS parent FROM t{_DEEPEST} GROUP BY host, template),
lag_ AS (SELECT *, lag(bad) OVER w AS bad0, lag(labelled) OVER w AS lab0 FROM leaf WHERE labelled > 0 WINDOW w AS (PARTITION BY host, parent ORDER BY bad / labelled, template)),
apart AS (SELECT *, CASE WHEN bad0 IS NULL OR abs(bad / labelled - bad0 / lab0) > 1.0 * sqrt((bad + bad0 + 1) / (labelled + lab0 + 2) * (1 - (bad + bad0 + 1) / (labelled + lab0 + 2)) * (1 / labelled + 1 / lab0)) THEN 1 ELSE 0 END AS cut FROM lag_),
br AS (SELECT *, sum(cut) OVER (PARTITION BY host, parent ORDER BY bad / labelled, template) AS branch FROM apart),
pool AS (SELECT host, template, sum(bad) OVER p AS b, sum(labelled) OVER p AS m FROM br WINDOW p AS (PARTITION BY host, parent, branch)),
every AS (SELECT host, template, bad, labelled, k, array_to_string(list_slice(string_split(template, '/'), 1, k), '/') AS above FROM (SELECT *, unnest(range(1, greatest(len(string_split(template, '/')) - 1, 1) + 1)) AS k FROM leaf) u),
known AS (SELECT host, above, sum(bad) AS b0, sum(labelled) AS m0 FROM every WHERE labelled > 0 GROUP BY host, above),
heir AS (SELECT e.host, e.template, arg_max(b0, k) AS b, arg_max(m0, k) AS m FROM every e JOIN known n ON n.host = e.host AND n.above = e.above WHERE labelled = 0 GROUP BY e.host, e.template),
pure AS (SELECT host, template, (b + 1.0) / (m + 4.0) AS q, m + 4.0 AS t FROM (SELECT host, template, b, m FROM pool UNION ALL SELECT host, template, b, m FROM heir) u),
rej AS (SELECT host, template FROM pure WHERE q - sqrt(q * (1 - q) / t) >= 0.8),
hit AS (SELECT x.host, x.raw, x.template FROM t{_DEEPEST} x JOIN rej USING (host, template))
SELECT page_id, s.host, path, rule, coalesce(by_rule, CASE WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.template FROM s LEFT JOIN hit ON hit.host = s.host AND hit.raw = s.raw
"""
)

ORACLES = {"op2_substring": OP2, "op4_linededup": OP4, "op7_url_filter": OP7, "op8_decontamination": OP8, "op9_quality": OP9}
