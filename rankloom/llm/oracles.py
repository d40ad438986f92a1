"""DuckDB SQL for the training-data queries that SQL expresses, over whole tables."""

from __future__ import annotations

from . import licenses
from .quality_rules import BASE, CURRENT, RULES, mask

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo_words
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask(BASE)} <> 0 AS base_failed, failures & {mask(CURRENT)} = 0 AS kept, n_lines, failures FROM f"""

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = s.doc_id AS kept FROM sets s JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS ws FROM documents), b AS (SELECT item_id, {TERMS} AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LISTED = ", ".join(f"({_quoted(name)}, {i}, {_quoted(t)})" for name, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts))
_HEADER = f"(?i){licenses.HEADER}"
_TERMS = f"regexp_extract_all(lower({{}}), '{licenses.TERM}')"
LICENSES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
o AS (SELECT *, regexp_matches(parts[1], '{_HEADER}') OR regexp_matches(parts[-1], '{_HEADER}') AS opens FROM d),
files AS (SELECT doc_id, text, CASE WHEN opens AND length(text) < 400 THEN s || '/LICENSE-' || doc_id WHEN opens THEN s || '/' || l || '/LICENSE-' || doc_id ELSE s || '/' || l || '/' || doc_id || '.txt' END AS path FROM o),
found AS (SELECT path, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_HEADER}')))) AS line FROM files WHERE regexp_matches(text, '{_HEADER}')),
lines AS (SELECT line, count(*) AS files FROM found GROUP BY line), total AS (SELECT coalesce(sum(files), 0) AS n FROM lines),
tokens AS (SELECT line, files, term, count(*) AS tf FROM (SELECT line, files, unnest({_TERMS.format('line')}) AS term FROM lines) GROUP BY ALL),
listed AS (SELECT license, wording, term, count(*) AS tf FROM (SELECT license, wording, unnest({_TERMS.format('text')}) AS term FROM (VALUES {_LISTED}) t(license, wording, text)) GROUP BY ALL),
df AS (SELECT term, sum(files) AS df FROM tokens GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 1))) + 1 AS idf FROM (SELECT DISTINCT term FROM listed) LEFT JOIN df USING (term), total),
target AS (SELECT license, wording, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY license, wording)) AS t_norm FROM listed JOIN idf USING (term)),
vec AS (SELECT line, term, tf * coalesce(idf, ln((1 + n) / 2) + 1) AS v FROM tokens LEFT JOIN idf USING (term), total),
norms AS (SELECT line, sqrt(sum(v * v)) AS norm FROM vec GROUP BY line),
scored AS (SELECT line, license, round(sum(v * w) / (norm * t_norm), {licenses.SCORE_DIGITS}) AS score FROM vec JOIN target USING (term) JOIN norms USING (line) GROUP BY line, license, wording, norm, t_norm),
best AS (SELECT path, license, score FROM found JOIN scored USING (line) WHERE score >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
own AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM best),
dirs AS (SELECT dir, path AS by, license, score FROM own WHERE regexp_matches(lower(path), '{licenses.LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
placed AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
up AS (SELECT p.path, x.* EXCLUDE (dir) FROM placed p JOIN dirs x ON p.dir = x.dir OR x.dir = '' OR starts_with(p.dir, x.dir || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(x.dir) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(o.license, u.license) AS license, coalesce(o.score, u.score) AS score, CASE WHEN o.path IS NOT NULL THEN 'own' WHEN u.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN o.path IS NOT NULL THEN p.path ELSE u.by END AS licensed_by
FROM placed p LEFT JOIN own o ON o.path = p.path LEFT JOIN up u ON u.path = p.path"""

ORACLE_SQL = {
    "op2_quality_rules": QUALITY_RULES,
    "op3_license_scan": LICENSES,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op8_near_dedup": NEAR_DEDUP,
    "op9_decontamination": DECONTAMINATION,
}
