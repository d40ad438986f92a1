"""Parsing on a few rows of odd wordings, against rows written down by hand."""

import pytest
from oracle import compare
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import dates, text
from rankloom.operators import answers, boosts, evaluation, provisions, segments
from rankloom.plans import sample as S
from rankloom.plans.catalogue_legal import ANSWER_DDL, ANSWERS, SUPPLIED, SUPPLIED_DDL

SAMPLES, RUN = {}, []


def query(sql=None):
    def register(f):
        RUN.append(f)
        if sql:
            SAMPLES[f.__name__] = (f, sql)
        return f

    return register


SAID = [(1, "Rules 3, 5 to 7, 22 and 23 apply; see Section 9(1), section 9 ( 1 ) and rule 4."), (2, "Nothing here."), (3, "rule 8 to 6, Sections 12A"), (4, None)]
SAID_DDL = "id int, text string"
CLAUSES = [(1, "on the expiry of one year from the date of publication, the 13th November, 2025"), (2, "eighteen months after the date of publication"), (3, "on the date of their publication"), (4, "6 months from the date of publication; the 31st August, 2025"), (5, "never")]
REF_TEXTS = [(1, "sub-sections (1) to (3) and (10) of section 6"), (2, "section 15 of the Rights of Persons with Disabilities Act, 2016"), (3, "sections 18 to 20, 35 and clause (b) of sub-section (2) of section 17 of the Act"), (4, "section 9 except sub-section (1) of the said section"), (5, "clauses (a) to (c) of sub-section (1) of section 27")]
PATCHED = [
    ("rules", "r4", 1, "Any Shedule may be used.", [(30, 4, 0)]), ("rules", "r5", 2, "The Shedule of dismay may hold.", [(30, 5, 0), (31, 2, 16)]),
    ("rules", "n1", 3, "(a) one", [(30, 9, 0)]), ("rules", "n2", 4, "(b) two", [(30, 10, 0)]), ("rules", "n3", 5, "(c) three", [(30, 12, 0)]),
]
COLUMN_LINES = [(1, 10.0, "1. Breach of duty", 0), (1, 22.0, "to protect", 0), (1, 9.0, "250", 1), (1, 21.0, "crore", 1), (1, 40.0, "2. Children", 0), (1, 41.0, "200 crore", 1)]
WORDS = [(1, "The", 0.0, 10.0, 5.0), (1, "Act", 12.0, 20.0, 6.5), (1, "s", 20.5, 22.0, 7.0), (1, "Next", 0.0, 9.0, 20.0), (2, "Only", 1.0, 5.0, 3.0)]
RESULTS = '{"overall": {"retrieval": {"recall@5": 0.8, "mrr": 0.7}, "ok": true, "note": "x"}}'
PATHS = {"recall_5": "overall.retrieval.recall@5", "mrr": "overall.retrieval.mrr", "ok": "overall.ok", "note": "overall.note", "absent": "overall.absent"}
POINTS = [("c1", "a", 1, 1.0), ("c1", "a", 2, 5.0), ("c1", "b", 2, 5.2), ("c2", "a", 1, 0.0), ("c2", "b", 1, 9.0)]
ACT_CLAUSES = [(1, "sections 1 and 2 on the date of publication"), (2, "section 2 on the expiry of one year from the date of publication"), (3, "sub-sections (1) to (2) of section 9, eighteen months after the date of publication")]
SUB_RULES = [(1, "Rules 1 and 2 shall come into force on the date of publication"), (2, "Rules 2 to 4 shall come into force one year after the date of publication"), (3, "nothing")]
PAGE_LINES, PAGE_TABLES = [("d", 1, 50.0, "b"), ("d", 1, 10.0, "a"), ("d", 2, 5.0, "d")], [("d", 1, 60.0, [["c"]])]


@query(f"""WITH {S.cte('r', [(1, '3 5 6 7 22 23 4', 'section 9 1|rule 4 |rule 3 '), (2, '', ''), (3, '8', 'rule 8 |section 12A '), (4, None, None)], 'id int, rules string, named string')} SELECT id, rules, list_sort(string_split(named, '|')) AS parts FROM r""".replace("list_sort(string_split(named, '|')) AS parts", "array_to_string(list_sort(string_split(named, '|')), '|') AS named"))
def rule_numbers_and_mentions(spark, d):
    m = F.transform(text.mentions(F.col("text")), lambda x: F.concat(x["kind"], F.lit(" "), x["number"], F.lit(" "), F.coalesce(x["sub"], F.lit(""))))
    return spark.createDataFrame(SAID, SAID_DDL).select("id", F.array_join(text.rule_numbers(F.col("text")), " ").alias("rules"), F.array_join(F.array_sort(m), "|").alias("named"))


@query(f"WITH {S.cte('r', [(1, 12, '2025-11-13', '2026-11-13'), (2, 18, None, None), (3, 0, None, None), (4, 6, '2025-08-31', '2026-02-28'), (5, None, None, None)], 'id int, months int, published date, in_force_date date')} SELECT * FROM r")
def commencement_clauses(spark, d):
    months, day = dates.offset_months(F.col("text")), dates.gazette_date(F.col("text"))
    return spark.createDataFrame(CLAUSES, "id int, text string").select("id", months.alias("months"), day.alias("published"), F.add_months(day, months).alias("in_force_date"))


@query()
def extract_refs(spark, d):
    return segments.extract_refs(spark.createDataFrame(REF_TEXTS, "id int, text string"), 44)


@query(f"WITH {S.cte('r', [(1, 'section 6', 'section 6(1) section 6(2) section 6(3) section 6(10)'), (3, 'section 17 section 18 section 19 section 20 section 35', 'section 17(2)(b) section 18 section 19 section 20 section 35'), (4, 'section 9', 'section 9'), (5, 'section 27', 'section 27(1)(a) section 27(1)(c)')], 'id int, refers_to string, full_labels string')} SELECT * FROM r".replace("section 6(1) section 6(2) section 6(3) section 6(10)", "section 6(1) section 6(10) section 6(2) section 6(3)"))
def reference_labels(spark, d):
    out = segments.reference_labels(segments.extract_refs(spark.createDataFrame(REF_TEXTS, "id int, text string"), 44))
    return out.select("id", F.array_join("refers_to", " ").alias("refers_to"), F.array_join("refers_to_provisions", " ").alias("full_labels"))


@query(f"WITH {S.cte('r', [('1', None, None, '2025-11-13'), ('2', None, None, '2026-11-13'), ('9', '1', None, '2027-05-13'), ('9', '2', None, '2027-05-13')], S.CALENDAR_DDL)} SELECT * FROM r")
def commencement_calendar(spark, d):
    return segments.commencement_calendar(spark.createDataFrame(ACT_CLAUSES, "id int, text string"), "2025-11-13", 44)


@query(f"WITH {S.cte('r', [('1', '2025-11-13'), ('2', '2026-11-13'), ('3', '2026-11-13'), ('4', '2026-11-13')], 'rule string, in_force_date date')} SELECT * FROM r")
def rule_calendar(spark, d):
    return segments.rule_calendar(spark.createDataFrame(SUB_RULES, "id int, text string"), "2025-11-13")


@query()
def boost_citations(spark, d):
    return boosts.citations(S.questions(spark), S.chunks(spark))


@query()
def cross_ref_expand(spark, d):
    c = S.chunks(spark)
    refs = c.select("chunk_id", F.posexplode("refers_to_provisions").alias("pos", "label"))
    return provisions.expand(S.ranking(spark), refs, c, 2, 0.5)


@query()
def mention_support(spark, d):
    a = spark.createDataFrame(ANSWERS, ANSWER_DDL).select("answer_id", "text", F.col("cited").alias("citations"))
    chunks = S.chunks(spark).select("chunk_id", "section", "sub_section", "clause", "rule", "sub_rule", "refers_to", "refers_to_provisions", "text")
    return answers.mention_support(a, spark.createDataFrame(SUPPLIED, SUPPLIED_DDL).join(chunks, "chunk_id"))


@query(f"WITH {S.cte('r', [('t', 1, '1|Failure to take sub-section (5) steps|250 crore'), ('t', 2, '2|Children|200 crore'), ('u', 1, '1|x y|')], 'table_id string, row bigint, cells string')} SELECT * FROM r")
def table_continuation(spark, d):
    return segments.merged_rows(spark.createDataFrame(S.CELLS, S.CELL_DDL)).withColumn("cells", F.array_join("cells", "|"))


@query(f"""WITH {S.cte('r', [('(i)(a)', 30, 5, None, 'Shedule', 'Schedule', 'replace'), ('(i)(b)', 30, 9, 12, '(a) to (c)', '(b) to (d)', 'reletter'), ('(ii)', 31, 2, None, 'may', 'shall', 'replace')], 'item string, page int, line int, line_end int, old_text string, new_text string, kind string')} SELECT * FROM r""")
def parse_patches(spark, d):
    return spark.createDataFrame([(S.NOTICE,)], "text string").select(F.explode(segments.parse_patches(F.col("text"))).alias("p")).select("p.*")


@query(f"WITH {S.cte('r', [(1, '1', '1. Breach of duty to protect', '250 crore'), (1, '2', '2. Children', '200 crore')], 'page_id int, number string, breach string, penalty string')} SELECT * FROM r")
def anchored_rows(spark, d):
    lines = spark.createDataFrame(COLUMN_LINES, "page_id int, y0 double, text string, side int")
    return segments.anchored_rows(lines.where("side = 0"), lines.where("side = 1"))


@query(f"WITH {S.cte('r', [(1, 1, 'The Acts', 0.0, 5.0), (1, 2, 'Next', 0.0, 20.0), (2, 1, 'Only', 1.0, 3.0)], 'page_id int, line_no int, text string, x0 double, y double')} SELECT * FROM r")
def line_groups(spark, d):
    return segments.line_groups(spark.createDataFrame(WORDS, "page_id int, text string, x0 double, x1 double, y double"))


@query(f"WITH {S.cte('r', [('d', 1, 50.0, 'b', 1), ('d', 1, 60.0, '<c>', 2), ('d', 2, 5.0, 'd', 3)], 'doc_id string, pdf_page int, y0 double, shown string, ord int')} SELECT * FROM r")
def reading_order(spark, d):
    lines = spark.createDataFrame(PAGE_LINES, "doc_id string, pdf_page int, y0 double, text string")
    tables = spark.createDataFrame(PAGE_TABLES, "doc_id string, pdf_page int, y0 double, rows array<array<string>>")
    return segments.reading_order(lines, tables, 1, 20.0).select("doc_id", "pdf_page", "y0", F.coalesce("text", F.concat(F.lit("<"), F.array_join(F.flatten("rows"), " "), F.lit(">"))).alias("shown"), "ord")


@query()
def segment_numbered(spark, d):
    return segments.segment_numbered(spark.createDataFrame(S.LINES, S.LINE_DDL), 40, "THE SCHEDULE")


@query()
def segment_paragraphs(spark, d):
    return segments.segment_paragraphs(spark.createDataFrame(S.LINES, S.LINE_DDL).where("doc_id = 'd2'"))


@query()
def segment_schedules(spark, d):
    return segments.segment_schedules(spark.createDataFrame(S.SCHEDULE_LINES, S.LINE_DDL))


@query()
def apply_patches(spark, d):
    chunks = spark.createDataFrame(PATCHED, "doc_id string, chunk_id string, ord int, text string, spans array<struct<page:int,line_no:int,offset:int>>")
    patches = parse_patches(spark, d).select(F.lit("rules").alias("doc_id"), F.row_number().over(Window.orderBy("page", "line")).alias("seq"), "*")
    return segments.apply_patches(chunks, patches)


@query(f"WITH {S.cte('r', [('recall_5', 0.8), ('mrr', 0.7), ('ok', 1.0), ('note', None), ('absent', None)], 'metric string, value double')} SELECT * FROM r")
def baseline_snapshot(spark, d):
    return evaluation.snapshot(spark.createDataFrame([(RESULTS,)], "results string"), PATHS)


@query(f"WITH {S.cte('r', [('c1', True), ('c2', False)], 'chart string, collide boolean')} SELECT * FROM r")
def label_gaps(spark, d):
    return evaluation.labels_collide(spark.createDataFrame(POINTS, "chart string, series string, x int, y double"), 0.1)


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_sample(spark, sf_dir, name):
    compare(spark, sf_dir, *SAMPLES[name])


@pytest.mark.parametrize("f", RUN, ids=lambda f: f.__name__)
def test_sample_has_rows(spark, sf_dir, f):
    assert f(spark, sf_dir).count() > 0
