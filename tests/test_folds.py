"""Folds pass all documents of a partition in one Python call, whatever the batches that Arrow sends."""

import contextlib
import io

import pytest
from oracle import compare
from rankloom.operators import segments
from rankloom.plans import catalogue
from rankloom.plans import catalogue_generated as G


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture
def two_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def once(spark, sf_dir, name):
    p = plan(getattr(G, name)(spark, sf_dir))
    assert "InPandas" not in p
    return p.count("FileScan")


def notices(spark, n=7):
    made = [(k if k else None, i, t) for k in range(n) for i, t in enumerate([f"Notice {k}:", *(f"({chr(97 + j)}) item {j};" for j in range(k)), None])]
    return spark.createDataFrame(made[::-1], "doc_id int, ord bigint, text string")


def test_segment_paragraphs(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "segment_paragraphs") == 1
    got = {tuple(r) for r in segments.segment_paragraphs(notices(spark)).collect()}
    want = {(None, 0, "1", "Notice 0:")} | {(k, 0, "preamble", f"Notice {k}:") for k in range(1, 7)}
    assert got == want | {(k, j + 1, chr(97 + j), f"({chr(97 + j)}) item {j};") for k in range(7) for j in range(k)}


def test_segment_numbered(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "segment_numbered") == 1
    lines = spark.createDataFrame([(k, j, f"{j}. Head {k}— said;", None if j == 3 else k, j) for k in range(1, 6) for j in range(1, k + 1) if j < 3 or k < 3], "doc_id int, ord int, text string, page int, line_no int")
    got = {(r.doc_id, r.number): (r.title, r.text, [tuple(s) for s in r.spans]) for r in segments.segment_numbered(lines).collect()}
    assert got == {(k, j): (f"Head {k}", "said;", [(k, j, 0)]) for k in range(1, 6) for j in range(1, min(k, 2) + 1)}


def test_segment_schedules(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "segment_schedules") == 1
    lines = spark.createDataFrame([(k, i, t) for k in range(6) for i, t in enumerate(["THE FIRST SCHEDULE", "PART A", *(f"{j}. entry {j}" for j in range(1, k + 1))])][::-1], "doc_id int, ord bigint, text string")
    got = {tuple(r) for r in segments.segment_schedules(lines).select("doc_id", "seq", "part", "item", "text").collect()}
    assert got == {(k, j - 1, "A", str(j), f"entry {j}") for k in range(6) for j in range(1, k + 1)}


def test_line_groups(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "line_groups") == 1
    spans = [(k, f"{j}{c}", x, x + 9.0, 20.0 * j + x / 8) for k in range(6) for j in range(k) for c, x in (("a", 0.0), ("b", 12.0), ("c", 21.0))] + [(5, None, None, None, None)]
    got = {(r.page_id, r.line_no): (r.text, r.x0, r.y) for r in segments.line_groups(spark.createDataFrame(spans[::-1], "page_id int, text string, x0 double, x1 double, y double")).collect()}
    assert got == {(k, j + 1): (f"{j}a {j}b{j}c", 0.0, 20.0 * j) for k in range(6) for j in range(k)} | {(5, 6): ("", None, None)}


def test_page_lines(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "page_lines") == 3  # body, boxes of tables, numbers
    compare(spark, sf_dir, catalogue.QUERIES["page_lines"], catalogue.ORACLE["page_lines"])


def test_apply_patches(spark, sf_dir, two_rows):
    assert once(spark, sf_dir, "apply_patches") == 2
    chunks = spark.createDataFrame([(d, f"{d}:{i}", i, "It may." if i else None, [(1, i, 0)] if i else None) for d in range(5) for i in range(d + 1)], f"doc_id int, chunk_id string, ord int, text string, spans {segments.SPANS}")
    patches = spark.createDataFrame([(d, k, f"({k})", 1, line, None, old, "shall", "replace") for d in (2, 4, 9) for k, line, old in ((1, 2, "may"), (2, None, "It"), (3, 1, "ay"))], "doc_id int, seq int, item string, page int, line int, line_end int, old_text string, new_text string, kind string")
    got = {r.chunk_id: (r.text, r.text_original, r.n_patches, r.error) for r in segments.apply_patches(chunks, patches).collect()}
    assert got["2:2"] == ("It shall.", "It may.", 1, "(3)") and got["2:1"] == ("shall may.", "It may.", 1, "(3)") and got["2:0"] == (None, None, 0, "(3)")
    assert got["4:2"][0] == "It shall." and got["4:4"] == ("It may.", None, 0, "(3)") and got["3:3"] == ("It may.", None, 0, None) and len(got) == 15
