"""A small legal corpus, written for this engine, on which the operators for provisions are run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

ACT, RULES = "act", "rules"
_D1, _D2, _D3 = date(2025, 11, 13), date(2026, 11, 13), date(2027, 5, 13)
#: chunk_id, doc_type, gsr_no, title, section, sub_section, clause, rule, sub_rule, schedule, part, item, illustration,
#: text, in_force_date, refers_to, refers_to_provisions, corrected_by, corrects, see_rules
_ROWS = [
    ("act:s1(2)", ACT, None, "Short title and commencement", "1", "2", None, None, None, None, None, None, False, "It shall come into force on such date as may be notified.", _D1, [], [], None, [], []),
    ("act:s2(t)", ACT, None, "Definitions", "2", None, "t", None, None, None, None, None, False, "(t) “personal data” means any data about an individual;", _D1, [], [], None, [], []),
    ("act:s2(u)", ACT, None, "Definitions", "2", None, "u", None, None, None, None, None, False, "(u) “personal data breach” means any unauthorised processing of personal data;", _D1, [], [], None, [], []),
    ("act:s8(5)", ACT, None, "General obligations", "8", "5", None, None, None, None, None, None, False, "A Data Fiduciary shall protect personal data & take <reasonable> safeguards.", _D3, [], [], None, [], []),
    ("act:s9(1)", ACT, None, "Children", "9", "1", None, None, None, None, None, None, False, "Verifiable consent of the parent is needed.", _D3, [], [], None, [], []),
    ("act:s9(3)", ACT, None, "Children", "9", "3", None, None, None, None, None, None, False, "No tracking of children.", _D3, ["section 9"], ["section 9(1)"], None, [], []),
    ("act:s27(1)(a)", ACT, None, "Powers", "27", "1", "a", None, None, None, None, None, False, "(a) on a breach, to direct urgent measures;", _D1, [], [], None, [], []),
    ("act:s27(1)", ACT, None, "Powers", "27", "1", None, None, None, None, None, None, False, "The Board shall exercise these powers.", _D1, [], [], None, [], []),
    ("rules:r1(2)", RULES, None, "Short title and commencement", None, None, None, "1", "2", None, None, None, False, "Rules 1, 2 and 17 to 21 shall come into force on the date of their publication.", _D1, [], [], None, [], []),
    ("rules:r4", RULES, None, "Consent Manager", None, None, None, "4", None, None, None, None, False, "A person listed in the First Schedule may apply.", _D2, [], [], "G.S.R. 892(E)", [], []),
    ("rules:r8(3)", RULES, None, "Period for erasure", None, None, None, "8", "3", None, None, None, True, "See section 8(5) and the Third Schedule.", _D3, ["section 8"], ["section 8(5)"], None, [], []),
    ("rules:r10(1)", RULES, None, "Verifiable consent", None, None, None, "10", "1", None, None, None, False, "Verify the parent as section 9(1) asks.", _D3, ["section 9"], ["section 9(3)", "section 9(1)"], None, [], []),
    ("rules:sch1:A:1", RULES, None, "Conditions of registration", None, None, None, None, None, "First Schedule", "A", "1", False, "The applicant is a company.", _D2, ["section 6"], [], None, [], ["4"]),
    ("rules:sch1:B:11", RULES, None, "Obligations", None, None, None, None, None, "First Schedule", "B", "11", False, "Keep records of consent.", _D2, [], [], None, [], ["4"]),
    ("rules:sch2:N", RULES, None, "Standards", None, None, None, None, None, "Second Schedule", None, "Note (a)", False, "Interpretation.", _D3, [], [], None, [], []),
    ("act:sch:1", ACT, None, "Penalty", None, None, None, None, None, "The Schedule", None, "1", False, "Breach of section 8(5). Penalty: 250 crore rupees.", _D3, ["section 8"], ["section 8(5)"], None, [], []),
    ("gsr843:a", "notification", "G.S.R. 843(E)", "Commencement of the Act", None, None, "a", None, None, None, None, None, False, "Sections 1 and 2 come into force on the date of publication.", _D1, ["section 1", "section 2"], [], None, [], []),
    ("gsr892:(i)(a)", "corrigendum", "G.S.R. 892(E)", "Corrigendum", None, None, None, "4", None, None, None, None, False, "in page 30, line 5, for \"Shedule\", read \"Schedule\"", date(2025, 12, 10), [], [], None, ["rules:r4"], []),
]
CHUNKS = [(i, r[0].split(":")[0], *r) for i, r in enumerate(_ROWS)]
CHUNK_DDL = (
    "ord bigint, doc_id string, chunk_id string, doc_type string, gsr_no string, title string, section string, sub_section string, clause string,"
    " rule string, sub_rule string, schedule string, part string, item string, illustration boolean, text string, in_force_date date,"
    " refers_to array<string>, refers_to_provisions array<string>, corrected_by string, corrects array<string>, see_rules array<string>"
)
QUESTIONS = [
    ("q1", "What does Section 8(5) ask of a Data Fiduciary?"),
    ("q2", "What counts as 'personal data'?"),
    ("q3", "What is the meaning of personal data breach here?"),
    ("q4", "When do the Rules come into force?"),
    ("q5", "Was rule 4 corrected by a corrigendum?"),
    ("q6", "What is item 11 of Part B of the First Schedule?"),
    ("q7", "Does section 15 of the Rights of Persons with Disabilities Act, 2016 apply?"),
    ("q8", "Sub-sections (1) and (3) of section 9, and rule 10(1)?"),
    ("q9", "Tell me about children."),
]
QUESTION_DDL = "query_id string, text string"
RANKING = [
    ("q1", "act:s8(5)", 1, 0.9), ("q1", "rules:r8(3)", 2, 0.5), ("q2", "act:s8(5)", 1, 0.7), ("q2", "act:s2(u)", 2, 0.6), ("q4", "rules:r4", 1, 0.4),
    ("q5", "rules:r4", 1, 0.8), ("q5", "gsr892:(i)(a)", 2, 0.3), ("q6", "rules:sch1:A:1", 1, 0.6), ("q8", "rules:r10(1)", 1, 0.9), ("q8", "rules:r8(3)", 2, 0.4),
    ("q9", "act:s9(3)", 1, 0.9), ("q9", "act:s9(1)", 2, 0.8),
]
RANKING_DDL = "query_id string, chunk_id string, rank int, score double"
CALENDAR = [("1", "2", None, _D1), ("2", None, None, _D1), ("8", None, None, _D3), ("9", "1", None, _D3), ("9", "3", None, _D3), ("27", "1", "d", _D2), ("27", "1", None, _D1), ("6", "9", None, _D2), ("6", "1", None, _D3)]
CALENDAR_DDL = "section string, sub_section string, clause string, in_force_date date"
PENALTIES = [(1, 0, "8", "5", "250 crore rupees"), (2, 0, "9", None, "200 crore rupees"), (3, 0, "9", "3", "100 crore rupees"), (4, 1, "40", None, "none")]
PENALTY_DDL = "row_ord int, ref_ord int, section string, sub_section string, penalty string"
NOTICE = (
    '(i) in page 30, (a) line 5, for “Shedule”, read “Schedule”; (b) lines 9 to 12, for "(a) to (c)", read "(b) to (d)";'
    ' (ii) in page 31, line 2, for "may", read "shall"'
)
LINES = [
    ("d1", 1, "An Act for data."), ("d1", 2, "CHAPTER I"), ("d1", 3, "PRELIMINARY"), ("d1", 4, "1. Short title.—(1) This Act may be cited"), ("d1", 5, "as the Data Act."),
    ("d1", 6, "(2) It shall come into force;"), ("d1", 7, "2. Definitions of"), ("d1", 8, "words.—In this Act,—"), ("d1", 9, "(a) “data” means sub-"), ("d1", 10, "stance;"), ("d1", 11, "(b) “person” means anyone."),
    ("d1", 12, "Illustration"), ("d1", 13, "X is a person."), ("d1", 14, "THE SCHEDULE"), ("d1", 15, "1. Fee"), ("d2", 1, "The Government appoints,—"), ("d2", 2, "(a) the date;"), ("d2", 3, "(b) the place."), ("d2", 4, "2. Signed."),
]
LINE_DDL = "doc_id string, ord bigint, text string"
SCHEDULE_LINES = [
    ("s", 1, "FIRST SCHEDULE"), ("s", 2, "[See rule 4]"), ("s", 3, "PART A"), ("s", 4, "1. A company"), ("s", 5, "of good standing."), ("s", 6, "2. Funds."), ("s", 7, "PART B"), ("s", 8, "1. Records:"), ("s", 9, "(a) of consent;"),
    ("s", 10, "(b) of notices."), ("s", 11, "Note: keep seven years."), ("s", 12, "SECOND SCHEDULE"), ("s", 13, "[See rules 5 and 6]"), ("s", 14, "(a) lawful;"),
]
CELLS = [("t", 1, ["1", "Failure to take sub-", "250"]), ("t", 2, ["", "section (5) steps", "crore"]), ("t", 3, ["2", "Children", "200"]), ("t", 4, [" ", "", "crore"]), ("u", 1, ["1", "x\ny", ""])]
CELL_DDL = "table_id string, ord int, cells array<string>"


def chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHUNKS, CHUNK_DDL)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, QUESTION_DDL)


def ranking(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANKING, RANKING_DDL)


_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, (bool, int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def cte(name: str, rows: list[tuple], ddl: str) -> str:
    """The rows as a common table expression for the oracle's SQL."""
    cols = [c.split() for c in ddl.split(", ")]
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {_DUCK[t]}) AS {n}" for n, t in cols)
    return f"{name} AS (SELECT {cast} FROM (VALUES {listed}) t({', '.join(n for n, _ in cols)}))"
