"""Odd rows through the queries and the pipeline's stages themselves, over tables written for the purpose."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("rankloom.llm.queries")
from rankloom.llm import queries, token_store  # noqa: E402

LONG = " ".join(f"w{i % 4999}x{i % 13}" for i in range(40_000))
SAME = "the same words stand here again and again in this one text that is long enough to have several windows of twenty words each"
DOCS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (-5, "SPDX-License-Identifier: MIT", None, None), (None, "Copyright 2020 nobody\nmore of it here", "de", "a/b"), (None, None, None, None),
    (7, SAME, "en", "a"), (7, SAME, "en", "a"), (8, SAME, "de", "x"), (9, LONG, "en", "x"), (10, LONG, "en", "x"), (11, "tie tie tie", "de", "x"), (12, " \n\t ", "de", "x"), (11, "another text under the same id", "de", "x"),
]
#: Columns named as the operators' own.
EXTRA = "lang_pred score languages path license origin id key kept component_id n_words n_hit contaminated words text_x base h seg anchor start tags item fp".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    made = {}
    for name, rows in (("full", DOCS), ("empty", [])):
        d = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("bigint"))
        for i, c in enumerate(EXTRA):
            docs = docs.withColumn(c, F.lit(i))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, SAME), (2, None), (3, "")] if rows else [], "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("words", F.lit("x")).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(7, 1, 0), (9, 0, 0), (99, 1, 0), (None, 1, 0), (8, None, 0)] if rows else [], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("t")).write.parquet(f"{d}/labels.parquet")
        pages = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<article><h1>A title of it</h1><p>Some words stand here, and more of them follow.</p></article>" * 2), (None, None, "<p>x")]
        spark.createDataFrame(pages if rows else [], "page_id bigint, url string, html string").withColumn("text", F.lit("t")).withColumn("n_chars", F.lit(1)).write.parquet(f"{d}/pages.parquet")
        made[name] = str(d)
    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_is_answered(spark, tables, name):
    got = queries.QUERIES[name](spark, tables["full"]).collect()
    key = "page_id" if name.startswith("op1_") else "doc_id"
    want = Counter([1, 1, 2, 3, None] if key == "page_id" else [r[0] for r in DOCS])
    if name == "op9_decontamination":  # rows with one id and text are one
        want = Counter({i: len({t for j, t, *_ in DOCS if j == i}) for i in {r[0] for r in DOCS}})
    assert Counter(r[key] for r in got) == want
    assert queries.QUERIES[name](spark, tables["empty"]).count() == 0


def test_license_ids_come_from_the_rows(spark, tables):
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, tables["full"]).collect()}
    assert got[-5].license == "MIT" and got[-5].origin == "own" and got[None] is not None


def test_pipeline_stages_keep_their_columns(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("full", "empty"):
        docs = spark.read.parquet(f"{tables[name]}/documents.parquet")
        columns = docs.columns
        for stage_name, stage in pipeline.STAGES[:-1]:
            docs = pipeline.written(stage(spark, docs, tables[name]), "stage")
            assert docs.columns == columns, stage_name
        if name == "full":
            rows = docs.collect()
            assert all(r[c] == i for r in rows for i, c in enumerate(EXTRA)) and all(r.n_chars == len(r.text) for r in rows)
            assert {r.doc_id for r in rows}.isdisjoint({1, 2, 12, 10})  # no letter, or a later copy
        assert pipeline.encode(spark, docs, tables[name]).count() == docs.count()


def test_equal_ids_are_in_one_order(spark, monkeypatch):
    rows = [(5, f"text number {i} of this id") for i in range(200)] + [(5, "twice")] * 100 + [(4, "before"), (6, "after")]
    runs = []
    for size in (1 << 30, 300):
        monkeypatch.setattr(token_store, "SHARD_BYTES", size)
        store = token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.tokenizer_file("word_bpe_49k.json"))
        runs.append([(r.doc_id, r.ids_crc32) for r in store.documents().orderBy("start").collect()])
        shards = store.shards.count()
    assert runs[0] == runs[1] and len(runs[0]) == len(rows) and shards > 8


def test_a_folder_must_be_shared(monkeypatch):
    from rankloom.llm import common

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("K", (), {"get": staticmethod(lambda *a: None)})())})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())


def test_items_that_share_windows_are_all_named(spark):
    from rankloom.llm import decontamination

    items = spark.createDataFrame([(i, SAME + f" own{i}") for i in range(30)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x " + SAME), (2, SAME + " own3"), (3, "nothing of it")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    names = ",".join(sorted(map(str, range(30))))
    assert got[1].n_items == got[2].n_items == 30 and got[1].items_sha256 == hashlib.sha256(names.encode()).hexdigest()
    assert got[2].n_hit == got[2].n_words and got[1].n_hit == got[1].n_words - 1 and not got[3].contaminated
