"""The ingest job over a small act, its rules, a notice and a corrigendum; schedules of lines and tables."""

import datetime

import pytest

from rankloom.operators import segments
from rankloom.plans import ingest

LINE = "doc_id string, ord bigint, text string"
PLACED = LINE + ", page int, line_no int"


def test_schedules_of_lines_and_tables(spark):
    lines = [("r", 1, "FIRST SCHEDULE"), ("r", 2, "[See rule 4]"), ("r", 3, "PART A"), ("r", 4, "1. A line item"), ("r", 6, "that runs on."), ("r", 10, "SECOND SCHEDULE"), ("r", 11, "[See rule 5]"), ("r", 14, "Note: the end.")]
    tables = [
        ("r", 7, [["S. No.", "Duty", "Sum"], ["(1)", "(2)", "(3)"], ["2.", "Keep", "10"], ["", "records", ""]]), ("r", 8, [["3.", "Erase", "20"]]),
        ("r", 12, [["1.", "Bare", "x"]]), ("r", 0, [["9.", "before any schedule"]]),
    ]
    got = segments.segment_schedules(spark.createDataFrame(lines, LINE), spark.createDataFrame(tables, "doc_id string, ord bigint, rows array<array<string>>"))
    rows = [(r.seq, r.schedule, r.part, r.see, r.item, r.text) for r in got.orderBy("seq").collect()]
    assert rows == [
        (0, "First Schedule", "A", "rule 4", "1", "A line item that runs on."), (1, "First Schedule", "A", "rule 4", "2", "2. Duty: Keep records | Sum: 10"), (2, "First Schedule", "A", "rule 4", "3", "3. Duty: Erase | Sum: 20"),
        (3, "Second Schedule", None, "rule 5", "1", "1. Bare | x"), (4, "Second Schedule", None, "rule 5", "Note", "Note: the end."),
    ]


def test_spans_name_the_lines_of_a_chunk(spark):
    lines = [("r", 1, "1. Title— (1) first", 3, 9), ("r", 2, " ", 3, 10), ("r", 3, "line of it;", 3, 11), ("r", 4, "(2) second.", 4, 1)]
    got = segments.segment_numbered(spark.createDataFrame(lines, PLACED)).orderBy("seq").collect()
    assert [[(x.page, x.line_no, r.text[x.offset :]) for x in r.spans] for r in got] == [[(3, 9, "(1) first line of it;"), (3, 11, "line of it;")], [(4, 1, "(2) second.")]]


def corpus(spark, **kw):
    lines = lambda doc, *ts: spark.createDataFrame([(doc, i, t) for i, t in enumerate(ts)], LINE)
    rules = [("1. Start— (1) These are rules;", 1), ("(2) Rules 1 and 2 shall come into force on the date of publication;", 2), ("(3) Rule 3 shall come into force one year after the date of publication.", 3), ("2. Notice— A notice under section 2 is clear.", 4), ("3. Shedules— The Shedule names section 1.", 5)]
    given = {
        "act": lines("act", "1. Short title— This is the Act.", "2. Duties— (1) One must care;", "(2) and may ask under section 1."),
        "penalties": spark.createDataFrame([(1, "Breach of sub-section (1) of section 2 Penalty: 5 crore")], "ord int, text string"),
        "rules": spark.createDataFrame([("rules", i, t, 7, n) for i, (t, n) in enumerate(rules)], PLACED),
        "notices": lines("n1", "The Government appoints:", "(a) section 1 on the date of publication;", "(b) section 2 on the expiry of six months from the date of publication."),
        "corrigenda": spark.createDataFrame([("c1", '(i) in page 7, line 5, for "The Shedule", read "The Schedule";')], "doc_id string, text string"),
    }
    return ingest.build(**(given | kw), published="2025-01-31", rules_published="2025-03-01", enacted="2023-08-11")


def test_the_whole_job(spark):
    out = corpus(spark, schedules=spark.createDataFrame([("rules", 0, "First Schedule", "A", "rules 2 and 3", "1", "Text")], "doc_id string, seq int, schedule string, part string, see string, item string, text string"))
    got = {r.chunk_id: r for r in out.chunks.collect()}
    day = datetime.date
    assert got["act:s1"].in_force_date == day(2025, 1, 31) and got["act:s2(1)"].in_force_date == day(2025, 7, 31)
    assert got["act:s2(1)"].penalty == "5 crore" and got["act:s2(2)"].penalty is None and got["act:s2(2)"].refers_to == ["section 1"]
    assert got["rules:r2"].in_force_date == day(2025, 3, 1) and got["rules:r3"].in_force_date == day(2026, 3, 1)
    assert got["rules:r3"].text == "The Schedule names section 1." and got["rules:r3"].text_original == "The Shedule names section 1." and got["rules:r3"].refers_to == ["section 1"]
    assert got["rules:sch:First Schedule:A:1"].in_force_date == day(2025, 3, 1) and got["rules:sch:First Schedule:A:1"].see_rules == ["2", "3"]
    assert {"notice:n1:preamble", "notice:n1:a", "notice:n1:b", "corrigendum:c1:(i)"} <= set(got)
    order = [r.chunk_id for r in out.chunks.orderBy("ord").collect()]
    assert [x.split(":")[0] for x in order] == sorted((x.split(":")[0] for x in order), key=["act", "rules", "notice", "corrigendum"].index)
    assert out.patches.count() == 1 and out.rule_dates.count() == 3


def test_repeated_ids_raise(spark):
    twice = spark.createDataFrame([(d, i, t) for d in ("a", "b") for i, t in enumerate(["1. Short title— This is the Act."])], LINE)
    with pytest.raises(ValueError, match="act:s1"):
        corpus(spark, act=twice)
