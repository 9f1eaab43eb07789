"""SQL twins of the operators that SQL can express, for DuckDB."""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1) || 'null') AS host FROM documents),
w AS (SELECT doc_id, host, t, {WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM p), range(0, 5) AS r(k) WHERE m > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  cast(10 * n_symbols > greatest(n_words, 1) AS int) + cast(10 * n_dup_lines > 3 * greatest(n_lines, 1) AS int) + cast(NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 15) AS int) AS soft_failed FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed > 0) AS k FROM j GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * avg(1 / n) AS spread FROM h),
s AS (SELECT m, least(greatest(CASE WHEN spread > 0 THEN m * (1 - m) / spread - 1 ELSE 1e6 END, 1), 1e6) AS s FROM m),
r AS (SELECT host, (k + m * s) / (n + s) AS rate FROM h, s)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND soft_failed < 2 AND (soft_failed = 0 OR rate <= 0.5) AS kept, soft_failed, round(rate, 9) AS host_rate FROM j JOIN r USING (host)
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM w, unnest(range(1, len(ws) - 3)) AS u(i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT r.u AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.v) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.u GROUP BY r.u
"""

OP2 = rf"""
WITH l AS (SELECT doc_id, i - 1 AS line, ls[i] AS s, len({WORDS.format('ls[i]')}) AS w FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
o AS (SELECT *, row_number() OVER q AS o, sum(w) OVER q AS cum FROM l WHERE w > 0 WINDOW q AS (PARTITION BY doc_id ORDER BY line)),
d AS (SELECT doc_id, list(s ORDER BY o) AS ss, list(line ORDER BY o) AS lines FROM o GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.o AS a, b.o AS b FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.o >= a.o AND b.cum - a.cum + a.w >= 50),
win AS (SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM pairs GROUP BY doc_id, b),
k AS (SELECT win.doc_id, a, b, array_to_string(list_slice(ss, a, b), chr(10)) AS key, lines[a] AS l0, lines[b] AS l1 FROM win JOIN d USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER q AS fd, first_value(a) OVER q AS fa FROM k WINDOW q AS (PARTITION BY key ORDER BY doc_id, a)),
g AS (SELECT DISTINCT doc_id, line FROM f, unnest(range(l0, l1 + 1)) AS u(line) WHERE doc_id <> fd OR a >= fa + b - a + 1),
x AS (SELECT l.doc_id, coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS t, coalesce(sum(l.w) FILTER (g.line IS NULL), 0) AS n, count(g.line) AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT doc_id, cast(n AS bigint) AS n_words_left, cast(length(t) AS bigint) AS n_chars_left, cast(gone AS bigint) AS n_lines_removed, md5(t) AS text_md5 FROM x
"""
