"""Parsing and reference queries over texts that are made from the rows of `lineitem`.

Each text is put together by the same SQL in Spark and in DuckDB; Spark parses it, and the SQL beside it computes what
must come out from the columns that went in, without any parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import answers, boosts, evaluation, models, pages, provisions, segments
from .catalogue_data import query

#: An order o has rows i = 1, 2, ... with a part p, a supplier s, a day d and a number y.
ROWS = """SELECT o, CAST(row_number() OVER (PARTITION BY o ORDER BY n) AS INT) AS i, p, s, d, y FROM
    (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_shipdate) AS d, min(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""
SOURCE = f"r AS ({ROWS})"
MONTHS = "CASE month(d) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
WORD = "CASE i WHEN 1 THEN 'one' WHEN 2 THEN 'six' WHEN 3 THEN 'twelve' WHEN 4 THEN 'eighteen' WHEN 5 THEN '7' WHEN 6 THEN 'twenty-four' ELSE 'seven' END"
NUMBER = "CASE i WHEN 1 THEN 1 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 18 WHEN 5 THEN 7 WHEN 6 THEN 24 ELSE 7 END"


def made(spark: SparkSession, d: str, columns: str, of: str = "r") -> DataFrame:
    return spark.sql(f"WITH {SOURCE} SELECT {columns} FROM {of}".replace(" lineitem ", f" parquet.`{d}/lineitem.parquet` "))


def several(spark: SparkSession, d: str, key: str, parts: list[tuple[str, str]], of: str = "r") -> DataFrame:
    """What each of parts (columns, condition) makes of a row, in one pass over the rows."""
    each = ", ".join(f"CASE WHEN {where} THEN struct({columns}) END" for columns, where in parts)
    return made(spark, d, f"{key}, inline(array_compact(array({each})))", of)


# -- numbers, dates ----------------------------------------------------------------------------------------------------

RULES_SAID = "'Rules ' || (p % 50 + 1) || ', ' || (s % 40 + 60) || ' to ' || (s % 40 + 59 + i % 4) || ' and ' || (o % 30 + 200) || ' apply; see Section ' || (p % 44 + 1) || '(' || i || ') and rule ' || (s % 20 + 300) || '.'"


@query(f"""WITH {SOURCE} SELECT o * 10 + i AS id, array_to_string(list_concat([p % 50 + 1], list_concat(range(s % 40 + 60, s % 40 + 61 + greatest(i % 4 - 1, 0)), [o % 30 + 200, s % 20 + 300])), ' ') AS rules,
    array_to_string(list_sort(['rule ' || (p % 50 + 1) || ' ', 'rule ' || (s % 20 + 300) || ' ', 'section ' || (p % 44 + 1) || ' ' || i]), '|') AS named FROM r""")
def rule_numbers_and_mentions(spark, d):
    m = F.transform(text.mentions(F.col("text")), lambda x: F.concat(x["kind"], F.lit(" "), x["number"], F.lit(" "), F.coalesce(x["sub"], F.lit(""))))
    rows = made(spark, d, f"o * 10 + i AS id, {RULES_SAID} AS text")
    return rows.select("id", F.array_join(text.rule_numbers(F.col("text")), " ").alias("rules"), F.array_join(F.array_sort(m), "|").alias("named"))


WHEN = f"CASE WHEN s % 5 = 0 THEN 'on the date of their publication' ELSE 'on the expiry of ' || {WORD} || CASE WHEN p % 2 = 0 THEN ' years' ELSE ' month' END || ' from the date of publication' END"
DAY = f"'the ' || day(d) || CASE WHEN day(d) IN (1, 21, 31) THEN 'st' WHEN day(d) IN (2, 22) THEN 'nd' WHEN day(d) IN (3, 23) THEN 'rd' ELSE 'th' END || ' ' || {MONTHS} || ', ' || year(d)"
OFFSET = f"CASE WHEN s % 5 = 0 THEN 0 ELSE ({NUMBER}) * CASE WHEN p % 2 = 0 THEN 12 ELSE 1 END END"


@query(f"WITH {SOURCE}, m AS (SELECT *, CAST({OFFSET} AS INT) AS months, CAST(d AS DATE) AS published FROM r) SELECT o * 10 + i AS id, months, published, CAST(published + to_months(months) AS DATE) AS in_force_date FROM m")
def commencement_clauses(spark, d):
    months, day = dates.offset_months(F.col("text")), dates.gazette_date(F.col("text"))
    return made(spark, d, f"o * 10 + i AS id, {WHEN} || ', ' || {DAY} AS text").select("id", months.alias("months"), day.alias("published"), F.add_months(day, months).alias("in_force_date"))


CLAUSE = f"'sub-section (' || i || ') of section ' || (p % 40 + 1) || ' on the expiry of ' || {WORD} || ' months after the date of publication'"


@query(f"WITH {SOURCE} SELECT CAST(p % 40 + 1 AS STRING) AS section, CAST(i AS STRING) AS sub_section, CAST(NULL AS STRING) AS clause, CAST(DATE '2025-11-13' + to_months(arg_max({NUMBER}, o * 10 + i)) AS DATE) AS in_force_date FROM r GROUP BY p % 40, i")
def commencement_calendar(spark, d):
    return segments.commencement_calendar(made(spark, d, f"o * 10 + i AS id, {CLAUSE} AS text"), "2025-11-13", 44)


RULE_CLAUSE = f"CASE WHEN s % 9 = 0 THEN 'Rule ' || (p % 100 + 1) || ' is as it was' ELSE 'Rules ' || (p % 100 + 1) || ' to ' || (p % 100 + 2) || ' shall come into force ' || {WORD} || ' months after the date of publication' END"


@query(f"WITH {SOURCE}, e AS (SELECT o * 10 + i AS id, {NUMBER} AS m, unnest([p % 100 + 1, p % 100 + 2]) AS rule FROM r WHERE s % 9 <> 0) SELECT CAST(rule AS STRING) AS rule, CAST(DATE '2025-11-13' + to_months(arg_max(m, id)) AS DATE) AS in_force_date FROM e GROUP BY rule")
def rule_calendar(spark, d):
    return segments.rule_calendar(made(spark, d, f"o * 10 + i AS id, {RULE_CLAUSE} AS text"), "2025-11-13")


# -- references --------------------------------------------------------------------------------------------------------

REFERS = """CASE i % 4 WHEN 0 THEN 'as sub-sections (1) to (' || (s % 4 + 2) || ') of section ' || (p % 40 + 1) || ' say'
    WHEN 1 THEN 'clause (' || chr(CAST(97 + s % 20 AS INT)) || ') of sub-section (' || i || ') of section ' || (p % 40 + 1) || ' of this Act'
    WHEN 2 THEN 'sections ' || (p % 40 + 1) || ' to ' || (p % 40 + 3) || ' and section ' || (s % 40 + 1) || ' of the Other Duties Act, 1999'
    ELSE 'section ' || (p % 40 + 1) || ' and section ' || (s % 40 + 1) || ', as well as section ' || (p % 40 + 1) || ' and section 99' END"""
REFERRED = f"""{SOURCE}, refs AS (
    SELECT id, pos, section, sub_section, clause, 'section ' || section || coalesce('(' || sub_section || ')', '') || coalesce('(' || clause || ')', '') AS label FROM (
    SELECT o * 10 + i AS id, CAST(k - 1 AS INT) AS pos, CAST(p % 40 + 1 AS STRING) AS section, CAST(k AS STRING) AS sub_section, CAST(NULL AS STRING) AS clause FROM (SELECT *, unnest(range(1, s % 4 + 3)) AS k FROM r WHERE i % 4 = 0)
    UNION ALL SELECT o * 10 + i, 0, CAST(p % 40 + 1 AS STRING), CAST(i AS STRING), chr(CAST(97 + s % 20 AS INT)) FROM r WHERE i % 4 = 1
    UNION ALL SELECT o * 10 + i, 0, CAST(p % 40 + 1 AS STRING), NULL, NULL FROM r WHERE i % 4 = 3
    UNION ALL SELECT o * 10 + i, 1, CAST(s % 40 + 1 AS STRING), NULL, NULL FROM r WHERE i % 4 = 3 AND p % 40 <> s % 40))"""


def _refs(spark, d) -> DataFrame:
    return segments.extract_refs(made(spark, d, f"o * 10 + i AS id, {REFERS} AS text"), 44)


@query(f"WITH {REFERRED} SELECT * FROM refs")
def extract_refs(spark, d):
    return _refs(spark, d)


@query(f"""WITH {REFERRED}, a AS (SELECT id, string_agg(x, ' ' ORDER BY n) AS refers_to FROM (SELECT DISTINCT id, 'section ' || section AS x, CAST(section AS INT) AS n FROM refs) GROUP BY id),
    b AS (SELECT id, string_agg(label, ' ' ORDER BY CAST(section AS INT), label[length('section ' || section) + 1:]) AS full_labels FROM refs GROUP BY id) SELECT * FROM a JOIN b USING (id)""")
def reference_labels(spark, d):
    out = segments.reference_labels(_refs(spark, d))
    return out.select("id", F.array_join("refers_to", " ").alias("refers_to"), F.array_join("refers_to_provisions", " ").alias("full_labels"))


#: Provisions that questions, answers and chunks speak of: sections 1 to 799 and rules 1 to 200 with parts 1 to 7, items.
CHUNKS = """(SELECT kind || ':' || a || '(' || b || ')' AS chunk_id, k AS ord, kind AS doc_type, CASE WHEN kind = 'act' THEN a END AS section, CASE WHEN kind = 'act' THEN b END AS sub_section, CAST(NULL AS STRING) AS clause,
    CASE WHEN kind = 'rules' THEN a END AS rule, CASE WHEN kind = 'rules' THEN b END AS sub_rule, CASE WHEN kind = 'entry' THEN 'First Schedule' END AS schedule, CASE WHEN kind = 'entry' THEN 'B' END AS part, CASE WHEN kind = 'entry' THEN a END AS item FROM
    (SELECT k, CASE WHEN k < 5593 THEN 'act' WHEN k < 6993 THEN 'rules' ELSE 'entry' END AS kind, CAST(CAST(floor(CASE WHEN k < 5593 THEN k WHEN k < 6993 THEN k - 5593 ELSE (k - 6993) * 7 END / 7) AS INT) + 1 AS STRING) AS a, CAST(CASE WHEN k < 6993 THEN k % 7 + 1 ELSE 1 END AS STRING) AS b FROM range(7043) AS t(k)) z) c"""
ASKS = """CASE i % 4 WHEN 0 THEN 'What does section ' || (p % 799 + 1) || '(' || i || ') say?' WHEN 1 THEN 'And rule ' || (p % 200 + 1) || ' (' || i || ')?'
    WHEN 2 THEN 'Is item ' || (s % 50 + 1) || ' of Part b of the first Schedule right, as section 3 of the Other Duties Act has it?' ELSE 'See sub-section (' || i || ') and (1) of section ' || (p % 799 + 1) || '.' END"""


@query(f"""WITH {SOURCE} SELECT o * 10 + i AS query_id, 1 AS pos, CASE i % 4 WHEN 0 THEN 'act:' || (p % 799 + 1) || '(' || i || ')' WHEN 1 THEN 'rules:' || (p % 200 + 1) || '(' || i || ')' WHEN 2 THEN 'entry:' || (s % 50 + 1) || '(1)' ELSE 'act:' || (p % 799 + 1) || '(' || i || ')' END AS chunk_id FROM r
    WHERE i % 4 <> 2 UNION ALL SELECT o * 10 + i, 2, 'act:' || (p % 799 + 1) || '(1)' FROM r WHERE i % 4 = 3""")
def boost_citations(spark, d):
    """A part letter in lower case names no row, as the lookup is by the letter as written."""
    return boosts.citations(made(spark, d, f"o * 10 + i AS query_id, {ASKS} AS text"), made(spark, d, "c.*", CHUNKS))


@query(f"""WITH {SOURCE}, n AS (SELECT o, max(i) AS n FROM r GROUP BY o), found AS (SELECT o, i, p, y, k, row_number() OVER (PARTITION BY o ORDER BY i, k) AS j FROM r, range(1, 3) AS t(k) WHERE p % 120 < 100)
    SELECT o AS query_id, 'q' || o || '-' || i AS chunk_id, i AS rank, y AS score, CAST(NULL AS STRING) AS expanded_from FROM r
    UNION ALL SELECT o, 'act:' || (i * 100 + p % 120) || '(' || k || ')', CAST(n + j AS INT), y * 0.5, 'q' || o || '-' || i FROM found JOIN n USING (o)""")
def cross_ref_expand(spark, d):
    results = made(spark, d, "o AS query_id, 'q' || o || '-' || i AS chunk_id, i AS rank, y AS score")
    refs = made(spark, d, "'q' || o || '-' || i AS chunk_id, CAST(k - 1 AS INT) AS pos, 'section ' || (i * 100 + CASE WHEN p % 120 < 100 THEN p % 120 ELSE 900 END) || '(' || k || ')' AS label", "r CROSS JOIN range(1, 4) AS t(k)")
    return provisions.expand(results, refs, made(spark, d, "c.*", CHUNKS), 2, 0.5)


NAMED = "'As Section ' || (p % 40 + 1) || '(' || i || ') says.'"


@query(f"""WITH {SOURCE} SELECT o * 10 + i AS answer_id, CASE WHEN p % 3 = 0 AND s % 2 = 1 THEN 'first own' WHEN s % 2 = 0 THEN 'own' ELSE 'first' END AS citations, CASE WHEN p % 3 = 0 OR (p % 3 = 1 AND s % 2 = 0) THEN '' ELSE 'Section ' || (p % 40 + 1) || '(' || i || ')' END AS unverified FROM r""")
def mention_support(spark, d):
    """A chunk is the provision (p % 3 = 0), refers to it (1) or is another (2), and is cited or not (s)."""
    a = made(spark, d, f"o * 10 + i AS answer_id, {NAMED} AS text, array(CASE WHEN s % 2 = 0 THEN 'own' ELSE 'first' END) AS citations")
    none = "CAST(NULL AS STRING)"
    own = made(spark, d, f"o * 10 + i AS answer_id, 1 AS rank, 'own' AS chunk_id, CAST(p % 40 + 1 + CASE WHEN p % 3 = 0 THEN 0 ELSE 50 END AS STRING) AS section, CAST(i AS STRING) AS sub_section, {none} AS clause, {none} AS rule, {none} AS sub_rule, array(CASE WHEN p % 3 = 1 THEN 'section ' || (p % 40 + 1) || '(' || i || ')' ELSE 'section 98' END) AS refers_to, CAST(NULL AS ARRAY<STRING>) AS refers_to_provisions, 'Text.' AS text")
    out = answers.mention_support(a, own)
    return out.select("answer_id", F.array_join("citations", " ").alias("citations"), F.array_join("unverified", "|").alias("unverified"))


# -- lines, columns, tables --------------------------------------------------------------------------------------------


@query(f"""WITH {SOURCE}, c AS (SELECT o, i, (i + 2) // 3 AS row, CASE WHEN p % 3 = 0 THEN 'word-' WHEN p % 3 = 1 THEN '' ELSE 'w' || p END AS c2 FROM r)
    SELECT o AS table_id, row::BIGINT AS row, (row * 3 - 2) || '|' || rtrim(coalesce(string_agg(c2 || CASE WHEN c2 LIKE '%-' THEN '' ELSE ' ' END, '' ORDER BY i) FILTER (c2 <> ''), '')) AS cells FROM c GROUP BY o, row""")
def table_continuation(spark, d):
    rows = made(spark, d, "o AS table_id, i AS ord, array(CASE WHEN i % 3 = 1 THEN CAST(i AS STRING) ELSE ' ' END, CASE WHEN p % 3 = 0 THEN 'word-' WHEN p % 3 = 1 THEN '' ELSE 'w' || p END) AS cells")
    return segments.merged_rows(rows).withColumn("cells", F.array_join("cells", "|"))


NOTICE = "'(i) in page ' || (p % 60 + 1) || ', line ' || i || ', for “x' || p || '”, read “y' || s || '”; (ii) in page ' || (s % 60 + 1) || ', (a) lines ' || i || ' to ' || (i + 2) || ', for “(a) to (c)”, read “(b) to (d)”.'"


@query(f"""WITH {SOURCE} SELECT o * 10 + i AS id, '(i)' AS item, CAST(p % 60 + 1 AS INT) AS page, i AS line, CAST(NULL AS INT) AS line_end, 'x' || p AS old_text, 'y' || s AS new_text, 'replace' AS kind FROM r
    UNION ALL SELECT o * 10 + i, '(ii)(a)', CAST(s % 60 + 1 AS INT), i, CAST(i + 2 AS INT), '(a) to (c)', '(b) to (d)', 'reletter' FROM r""")
def parse_patches(spark, d):
    return made(spark, d, f"o * 10 + i AS id, {NOTICE} AS text").select("id", F.explode(segments.parse_patches(F.col("text"))).alias("p")).select("id", "p.*")


@query(f"SELECT o AS page_id, CAST(i AS STRING) AS number, i || '. Breach ' || p || ' to keep ' || s AS breach, (p % 9 + 1) || ' hundred crore' AS penalty FROM ({ROWS}) r")
def anchored_rows(spark, d):
    side = lambda first, second, dy: made(spark, d, f"o AS page_id, CAST(i * 40 + {dy} AS DOUBLE) AS y0, {first} AS text").unionByName(made(spark, d, f"o AS page_id, CAST(i * 40 + {dy} + 12 AS DOUBLE) AS y0, {second} AS text"))
    return segments.anchored_rows(side("i || '. Breach ' || p", "'to keep ' || s", 0), side("(p % 9 + 1) || ' hundred'", "'crore'", -1))


@query(f"SELECT o AS page_id, i AS line_no, 'A' || p || CASE WHEN p % 2 = 0 THEN '' ELSE ' ' END || 'b' || s AS text, 0.0::DOUBLE AS x0, CAST(i * 20 AS DOUBLE) AS y FROM ({ROWS}) r")
def line_groups(spark, d):
    one = "'A' || p AS text, CAST(0 AS DOUBLE) AS x0, CAST(10 AS DOUBLE) AS x1, CAST(i * 20 AS DOUBLE) AS y"
    two = "'b' || s AS text, CAST(CASE WHEN p % 2 = 0 THEN 11 ELSE 13 END AS DOUBLE) AS x0, CAST(30 AS DOUBLE) AS x1, CAST(i * 20 + 1.5 AS DOUBLE) AS y"
    return segments.line_groups(several(spark, d, "o AS page_id", [(one, "true"), (two, "true")]))


@query(f"""WITH {SOURCE}, b AS (SELECT o, i, CAST(p % 100 AS DOUBLE) AS y0, 'L' || p AS shown, 0 AS t FROM r UNION ALL SELECT o, i, CAST(s % 100 AS DOUBLE), '<T' || s || '>', 1 FROM r WHERE s % 3 = 0)
    SELECT o AS doc_id, i AS pdf_page, y0, shown, CAST((SELECT count(*) FROM b a WHERE a.o = b.o AND (a.i > 2 OR (a.i = 2 AND a.y0 >= 30)) AND (a.i, a.y0, a.t) <= (b.i, b.y0, b.t)) AS INT) AS ord FROM b WHERE i > 2 OR (i = 2 AND y0 >= 30)""")
def reading_order(spark, d):
    lines = made(spark, d, "o AS doc_id, i AS pdf_page, CAST(p % 100 AS DOUBLE) AS y0, 'L' || p AS text")
    tables = made(spark, d, "o AS doc_id, i AS pdf_page, CAST(s % 100 AS DOUBLE) AS y0, array(array('T' || s)) AS rows", "r WHERE s % 3 = 0")
    return segments.reading_order(lines, tables, 2, 30.0).select("doc_id", "pdf_page", "y0", F.coalesce("text", F.concat(F.lit("<"), F.array_join(F.flatten("rows"), " "), F.lit(">"))).alias("shown"), "ord")


# -- segmentation ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SOURCE}, u AS (SELECT o, i, 1 AS sub, 'Heading ' || p AS title, '(1) first ' || s || ';' || CASE WHEN s % 2 = 0 THEN '' ELSE ' running on ' || o || '.' END AS text FROM r UNION ALL SELECT o, i, 2, 'Heading ' || p, '(2) second ' || o || ';' FROM r WHERE s % 2 = 0)
    SELECT o AS doc_id, CAST(i - 1 + (SELECT count(*) FROM r WHERE r.o = u.o AND s % 2 = 0 AND (r.i < u.i OR (r.i = u.i AND u.sub = 2))) AS INT) AS seq, i AS number, sub, CAST(NULL AS STRING) AS clause, 'text' AS kind, title, CAST(NULL AS STRING) AS chapter, CAST(NULL AS STRING) AS lead_in, text FROM u""")
def segment_numbered(spark, d):
    head = "CAST(i * 2 AS BIGINT) AS ord, i || '. Heading ' || p || '— (1) first ' || s || ';' AS text"
    rest = "CAST(i * 2 + 1 AS BIGINT) AS ord, CASE WHEN s % 2 = 0 THEN '(2) second ' || o || ';' ELSE 'running on ' || o || '.' END AS text"
    return segments.segment_numbered(several(spark, d, "o AS doc_id", [(head, "true"), (rest, "true")]))


@query(f"""WITH {SOURCE} SELECT o AS doc_id, i AS seq, chr(96 + i) AS label, '(' || chr(96 + i) || ') item ' || p || '; more' AS text FROM r WHERE s % 2 = 1 AND i = (SELECT max(i) FROM r x WHERE x.o = r.o)
    UNION ALL SELECT o, i, chr(96 + i), '(' || chr(96 + i) || ') item ' || p || ';' FROM r WHERE s % 2 = 0 OR i < (SELECT max(i) FROM r x WHERE x.o = r.o) UNION ALL SELECT DISTINCT o, 0, 'preamble', 'Notice ' || o || ':' FROM r""")
def segment_paragraphs(spark, d):
    """The last item of some notices runs on."""
    opening = "CAST(0 AS BIGINT) AS ord, 'Notice ' || o || ':' AS text"
    item = "CAST(i * 2 AS BIGINT) AS ord, '(' || chr(96 + i) || ') item ' || p || ';' AS text"
    more = "CAST(i * 2 + 1 AS BIGINT) AS ord, 'more' AS text"
    return segments.segment_paragraphs(several(spark, d, "o AS doc_id", [(opening, "i = 1"), (item, "true"), (more, "s % 2 = 1 AND i = last")], "(SELECT *, max(i) OVER (PARTITION BY o) AS last FROM r) z"))


@query(f"""WITH {SOURCE} SELECT o AS doc_id, i * 2 - 2 AS seq, 'First Schedule' AS schedule, 'A' AS part, 'rule ' || o AS see, CAST(i AS STRING) AS item, 'Entry ' || p AS text FROM r
    UNION ALL SELECT o, i * 2 - 1, 'First Schedule', 'A', 'rule ' || o, i || '(a)', '(a) sub ' || s FROM r""")
def segment_schedules(spark, d):
    heads = [(f"CAST({k} AS BIGINT) AS ord, {t} AS text", "i = 1") for k, t in ((-3, "'THE FIRST SCHEDULE'"), (-2, "'[See rule ' || o || ']'"), (-1, "'PART A'"))]
    rows = [(f"CAST(i * 2 + {k} AS BIGINT) AS ord, {t} AS text", "true") for k, t in ((0, "i || '. Entry ' || p"), (1, "'(a) sub ' || s"))]
    return segments.segment_schedules(several(spark, d, "o AS doc_id", heads + rows))


@query(f"""WITH {SOURCE}, e AS (SELECT o, string_agg('item ' || i, ', ' ORDER BY i) AS error FROM r WHERE s % 7 = 3 GROUP BY o)
    SELECT o AS doc_id, o || ':' || i AS chunk_id, 'Row ' || i || ' of ' || CASE WHEN s % 7 < 3 THEN 'Schedule ' ELSE 'Shedule ' END || p || ' holds.' AS text, CASE WHEN s % 7 < 3 THEN 'Row ' || i || ' of Shedule ' || p || ' holds.' END AS text_original, CASE WHEN s % 7 < 3 THEN 1 ELSE 0 END AS n_patches, error FROM r LEFT JOIN e USING (o)""")
def apply_patches(spark, d):
    chunks = made(spark, d, "o AS doc_id, o || ':' || i AS chunk_id, i AS ord, 'Row ' || i || ' of Shedule ' || p || ' holds.' AS text, array(named_struct('page', i, 'line_no', CAST(p % 30 AS INT), 'offset', 0)) AS spans")
    patches = made(spark, d, "o AS doc_id, i AS seq, 'item ' || i AS item, i AS page, CAST(p % 30 AS INT) AS line, CAST(NULL AS INT) AS line_end, CASE WHEN s % 7 = 3 THEN 'Shed' ELSE 'Shedule' END AS old_text, 'Schedule' AS new_text, 'replace' AS kind", "r WHERE s % 7 <= 3")
    return segments.apply_patches(chunks, patches)


# -- results -----------------------------------------------------------------------------------------------------------

RUN = "'{\"overall\": {\"retrieval\": {\"recall@5\": ' || CAST(avg(i) AS STRING) || ', \"mrr\": ' || count(DISTINCT p) || '}, \"ok\": ' || CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END || ', \"note\": \"' || max(s) || 'x\"}}'"
PATHS = {"recall_5": "overall.retrieval.recall@5", "mrr": "overall.retrieval.mrr", "ok": "overall.ok", "note": "overall.note", "absent": "overall.absent"}


@query(f"WITH {SOURCE}, v AS (SELECT round(avg(i), 9) AS a, count(DISTINCT p)::DOUBLE AS m FROM r) SELECT 'recall_5' AS metric, a AS value FROM v UNION ALL SELECT 'mrr', m FROM v UNION ALL SELECT 'ok', 1.0 UNION ALL SELECT 'note', NULL UNION ALL SELECT 'absent', NULL")
def baseline_snapshot(spark, d):
    return evaluation.snapshot(made(spark, d, f"{RUN} AS results"), PATHS).withColumn("value", F.round("value", 9))


@query(f"""WITH {SOURCE}, span AS (SELECT o, max(greatest(p % 100, s % 100)) - min(least(p % 100, s % 100)) AS w FROM r GROUP BY o)
    SELECT o AS chart, EXISTS (SELECT 1 FROM r a JOIN r b ON a.o = b.o AND a.i < b.i WHERE a.o = span.o AND abs(a.s % 100 - b.s % 100) < 0.1 * w) AS collide FROM span""")
def label_gaps(spark, d):
    points = made(spark, d, "o AS chart, i AS series, 1 AS x, CAST(p % 100 AS DOUBLE) AS y").unionByName(made(spark, d, "o AS chart, i AS series, 2 AS x, CAST(s % 100 AS DOUBLE) AS y"))
    return evaluation.labels_collide(points, 0.1)


# -- models' words, printed pages --------------------------------------------------------------------------------------

SAID = "CASE WHEN s % 7 = 0 THEN 'no answer' ELSE '{\"answer\": \"A' || p || '\", \"refused\": ' || CASE WHEN s % 4 = 0 THEN 'true' ELSE 'false' END || ', \"citations\": [\"c' || (p % 3) || '\", \"c0\", \"c9\"]}' END"
STATE = "CASE WHEN o % 5 = 0 OR i = 3 THEN 'refused' WHEN i = 2 THEN 'truncated' WHEN s % 7 = 0 THEN 'invalid' WHEN s % 4 = 0 THEN 'refused' ELSE 'answered' END"


@query(f"""WITH {SOURCE}, a AS (SELECT *, {STATE} AS state FROM r) SELECT o * 10 + i AS answer_id, state, CASE WHEN state = 'answered' THEN 'A' || p END AS answer, CASE WHEN state <> 'answered' THEN '' WHEN p % 3 = 1 THEN 'c1 c0' ELSE 'c0' END AS citations,
    state = 'refused' AS refused, CASE WHEN state <> 'refused' THEN NULL WHEN o % 5 = 0 THEN 'insufficient_context' ELSE 'model_refusal' END AS refusal_reason FROM a""")
def answer_states(spark, d):
    calls = made(spark, d, f"o * 10 + i AS answer_id, {SAID} AS text, CASE i WHEN 2 THEN 'max_tokens' WHEN 3 THEN 'refusal' ELSE 'end_turn' END AS stop_reason")
    supplied = made(spark, d, "o * 10 + i AS answer_id, 'c' || k AS chunk_id", "r CROSS JOIN range(2) AS t(k) WHERE o % 5 <> 0")
    return models.answered(calls, supplied).withColumn("citations", F.array_join("citations", " "))


@query(f"""WITH {SOURCE}, v AS (SELECT o * 10 + i AS item_id, CASE i % 4 WHEN 0 THEN 'faithfulness' WHEN 1 THEN 'relevance' WHEN 2 THEN 'refusal' ELSE 'injection' END AS metric,
    CASE WHEN s % 11 = 0 THEN NULL WHEN i % 4 >= 2 THEN p % 2 WHEN p % 7 BETWEEN 1 AND 5 THEN p % 7 END::DOUBLE AS value, 'because ' || p AS reasoning FROM r) SELECT *, value IS NULL AS failed FROM v""")
def judgements_parsed(spark, d):
    said = "'{\"reasoning\": \"because ' || p || '\", ' || CASE WHEN i % 4 >= 2 THEN '\"correct\": ' || CASE WHEN p % 2 = 1 THEN 'true' ELSE 'false' END ELSE '\"score\": ' || (p % 7) END || '}'"
    metric = "CASE i % 4 WHEN 0 THEN 'faithfulness' WHEN 1 THEN 'relevance' WHEN 2 THEN 'refusal' ELSE 'injection' END"
    return models.judged(made(spark, d, f"o * 10 + i AS item_id, {metric} AS metric, {said} AS text, CASE WHEN s % 11 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason"))


@query(f"WITH {SOURCE} SELECT o * 10 + i AS query_id, CASE WHEN s % 5 > 1 THEN 'Q' || p END AS statutory_query, CASE WHEN s % 5 > 1 THEN array_to_string(list_transform(range(1, least(i, 4) + 1), lambda k: 'issue ' || k), '|') ELSE '' END AS sub_issues, s % 5 <= 1 AS fell_back FROM r")
def rewrites_parsed(spark, d):
    said = "CASE WHEN s % 5 = 0 THEN '[' ELSE '{\"statutory_query\": \"Q' || p || '\", \"sub_issues\": [' || array_join(transform(sequence(1, i), k -> '\"issue ' || k || '\"'), ', ') || ']}' END"
    out = models.rewritten(made(spark, d, f"o * 10 + i AS query_id, {said} AS text, CASE WHEN s % 5 = 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason"))
    return out.withColumn("sub_issues", F.array_join("sub_issues", "|"))


PRINT = pages.PageSettings(header_max_y=30.0, footer_min_y=800.0, min_font_size=6.0, watermark_words=("IndiaCode",), watermark_colors=(255,), footer_patterns=(r"^\d+ of \d+$",))


@query(f"""WITH {SOURCE}, l AS (SELECT *, p % 5 <> 0 AND s % 6 <> 0 AS kept FROM r)
    SELECT o AS page_id, CAST(o % 1000 AS INT) AS page, CAST(row_number() OVER (PARTITION BY o ORDER BY i) AS INT) AS line_no, 'Word' || p || ' and ' || s AS text, 50.0::DOUBLE AS x0, (100 + i * 20)::DOUBLE AS y FROM l WHERE kept""")
def page_lines(spark, d):
    """Each row is a line of two spans, a rotated and a coloured one over it, perhaps in a table (p) or a watermark's piece (s);
    each page has a number in its header."""
    n = "CAST({} AS DOUBLE)".format
    cols = lambda t, x0, x1, y, size, color, slope: f"{t} AS text, {n(x0)} AS x0, {n(f'{y} - 5')} AS y0, {n(x1)} AS x1, {n(f'{y} + 5')} AS y1, {n(size)} AS size, {color} AS color, {n(slope)} AS slope"
    y, keep = "(100 + i * 20)", "s % 6 <> 0"
    spans = several(spark, d, "o AS page_id", [
        (cols("'Word' || p", 50, 90, y, 10, 0, 0), keep), (cols("'and ' || s", 95, 140, y, 10, 0, 0), keep), (cols("'di'", 50, 60, y, 10, 0, 0), "s % 6 = 0"), (cols("'slanted'", 60, 90, y, 10, 0, 0.7), "true"),
        (cols("'grey'", 60, 90, y, 10, 255, 0), "true"), (cols("'12'", 141, 143, y, 4, 0, 0), "true"), (cols("CAST(o % 1000 AS STRING)", 300, 320, 20, 10, 0, 0), "i = 1"),
    ])
    tables = made(spark, d, f"o AS page_id, CAST(40 AS DOUBLE) AS x0, {n(y + ' - 8')} AS y0, CAST(200 AS DOUBLE) AS x1, {n(y + ' + 8')} AS y1", "r WHERE p % 5 = 0")
    return pages.read_page_spans(spans, PRINT, tables)
