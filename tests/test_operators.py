"""Exact cases of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import dates, measures, text
from rankloom.operators import boosts, caches, evaluation, provisions, requests, retrieval, segments, spans
from rankloom.plans import sample as S
from rankloom.plans.retrieve import Settings, ranked
from rankloom.sources import readers


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_fusion_order_and_scores(spark):
    lists = [(0, "abc"), (1, "bcd")]
    rows = [("q", i, r, c, 1.0) for i, s in lists for r, c in enumerate(s, 1)]
    df = spark.createDataFrame(rows, "query_id string, list_idx int, rank int, chunk_id string, weight double")
    got = {r.chunk_id: r for r in retrieval.rrf(df, 60).collect()}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == ["b", "c", "a", "d"]
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and got["d"].score == pytest.approx(1 / 63, abs=1e-8)


def test_weighted_fusion_ties_go_to_the_first_list(spark):
    rows = [("q", 0, 1, "a", 1.0), ("q", 0, 2, "b", 1.0), ("q", 1, 1, "b", 1.0), ("q", 1, 2, "a", 1.0)]
    df = spark.createDataFrame(rows, "query_id string, list_idx int, rank int, chunk_id string, weight double")
    assert [(r.chunk_id, r.score) for r in retrieval.rrf(df, 0).orderBy("rank").collect()] == [("a", 1.5), ("b", 1.5)]
    less = df.withColumn("weight", F.when(F.col("list_idx") == 1, 0.25).otherwise(1.0))
    assert {r.chunk_id: r.score for r in retrieval.rrf(less, 0).collect()}["b"] == 0.75


def test_percentiles_are_nearest_rank(spark):
    log = spark.range(1, 101).select(F.col("id").cast("double").alias("latency_ms"))
    assert [log.agg(requests.percentile("latency_ms", p)).first()[0] for p in (50, 99, 100)] == [50, 99, 100]
    assert spark.createDataFrame([(7.0,)], "latency_ms double").agg(requests.percentile("latency_ms", 99)).first()[0] == 7
    assert log.where("false").agg(requests.percentile("latency_ms", 50)).first()[0] is None
    with pytest.raises(ValueError):
        requests.percentile("latency_ms", 0)


def test_request_summary_of_a_hundred(spark):
    rows = [(i, f"2025-01-01 {i % 24:02d}:00:00", "h", float(i), 1, 1, 0.01 if i % 2 else 0.03, int(i <= 10), int(i > 95), "api") for i in range(1, 101)]
    log = spark.createDataFrame(rows, "id int, ts string, config_hash string, latency_ms double, tokens_in int, tokens_out int, cost_usd double, cached int, refused int, source string").withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))
    r = requests.summary(log).first()
    assert (r.n, r.cached, r.refused, r.p50_ms, r.p99_ms, r.mean_cost, r.refusal_rate) == (100, 10, 5, 50, 99, 0.02, 0.05)
    assert log.where(requests.where("h", "api", None, False)).count() == 90
    assert log.where(requests.where(source="eval")).count() == 0
    bad = requests.checked(log.withColumn("source", F.lit("elsewhere")))
    with pytest.raises(Exception, match="breaks a constraint"):
        bad.collect()


def test_retrieval_metrics(spark):
    ranking = spark.createDataFrame([("q", c, r) for r, c in enumerate("abcde", 1)], "query_id string, chunk_id string, rank int")
    gold = lambda cs: spark.createDataFrame([("q", c) for c in cs], "query_id string, chunk_id string")
    a = evaluation.retrieval_metrics(ranking, gold("cz")).first()
    assert (a.recall_1, a.recall_3, a.hit_3, a.first_gold_rank) == (0, 0.5, 1, 3)
    assert evaluation.retrieval_metrics(ranking, gold("db")).first().mrr == 0.5
    assert evaluation.retrieval_metrics(ranking, gold("e"), depth=4).first().mrr == 0
    assert evaluation.retrieval_metrics(ranking, gold("bb")).first().n_gold == 1


def test_months_and_clauses(spark):
    rows = [("2025-11-13", 12, "2026-11-13"), ("2025-11-13", 18, "2027-05-13"), ("2025-08-31", 6, "2026-02-28")]
    df = spark.createDataFrame(rows, "d string, m int, want string")
    assert df.select(F.add_months(F.col("d").cast("date"), F.col("m")).cast("string") == F.col("want")).distinct().collect()[0][0] is True
    assert one(spark, dates.offset_months(F.lit("seven suns"))) is None


@pytest.mark.parametrize(
    "said, want",
    [
        ("sub-sections (1) to (3) and (10) of section 6", ["6(1)", "6(2)", "6(3)", "6(10)"]),
        ("section 15 of the Rights of Persons with Disabilities Act, 2016", []),
        ("section 4, section 5 and section 6 of the Other Code", []),
        ("section 7 of this Act and section 8", ["7", "8"]),
        ("sections 9 to 7", ["9"]),
        ("clauses (a) to (c) of sub-section (1) of section 27", ["27(1)(a)", "27(1)(c)"]),
    ],
)
def test_references(spark, said, want):
    rows = segments.extract_refs(spark.createDataFrame([(1, said)], "id int, text string")).orderBy("pos").collect()
    got = [r.section + (f"({r.sub_section})" if r.sub_section else "") + (f"({r.clause})" if r.clause else "") for r in rows]
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert got == want


def test_rule_numbers_and_tokens(spark):
    assert one(spark, text.rule_numbers(F.lit("Rules 3, 5 to 7, 22 and 23"))) == ["3", "5", "6", "7", "22", "23"]
    assert one(spark, text.tokens(F.lit("The consent of the Parent, 9(1)"), ("the", "of"))) == ["consent", "parent", "9", "1"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_text_helpers(spark):
    assert one(spark, text.squash(F.lit(" \n a \t b  "))) == "a b"
    assert one(spark, text.straight_quotes(F.lit("“x” ‘y’"))) == "\"x\" 'y'"
    assert one(spark, text.escaped(F.lit("<a & \"b\">"), True)) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, text.joined_cell(F.lit("sub-\nsection\n\n (1) "))) == "sub-section (1)"
    assert one(spark, F.lit("remay may").rlike("may")) and one(spark, F.regexp_count(F.lit("remay may"), text.literal_pattern(F.lit("may")))) == 1
    assert one(spark, text.rendered(F.lit(None).cast("string"), F.lit(" x "), 5)) == "x"


def test_provision_lookup(spark):
    chunks = S.chunks(spark)
    found = lambda label: sorted(r.chunk_id for r in provisions.lookup(spark.createDataFrame([(label,)], "label string"), chunks).collect())
    assert found("section 9") == ["act:s9(1)", "act:s9(3)"]
    assert found("section 8(5)(a)") == ["act:s8(5)"]
    assert found("section 27(1)(a)") == ["act:s27(1)(a)"]
    assert found("section 40") == [] and found("rule 4") == []


def test_filters(spark):
    chunks = S.chunks(spark)
    n = lambda day: chunks.where(retrieval.Filters(in_force_on=__import__("datetime").date.fromisoformat(day)).condition()).where("chunk_id = 'act:s9(1)'").count()
    assert n("2027-05-12") == 0 and n("2027-05-13") == 1
    assert chunks.where(retrieval.Filters().condition()).count() == len(S.CHUNKS)
    assert chunks.where(retrieval.Filters(rule=("4",)).condition()).count() == 2
    assert retrieval.Filters.from_config({"doc_type": "act"}) == retrieval.Filters(doc_type=("act",))


def test_expansion_leaves_to_a_later_parent_what_had_no_room(spark):
    act = [("act", f"s{n}", i, str(n), None, None) for i, n in enumerate((1, 2, 3))]
    chunks = spark.createDataFrame(act, "doc_type string, chunk_id string, ord int, section string, sub_section string, clause string")
    refs = spark.createDataFrame([("p1", i, f"section {n}") for i, n in enumerate((1, 2, 3))] + [("p2", 0, "section 3")], "chunk_id string, pos int, label string")
    results = spark.createDataFrame([("q", "p1", 1, 1.0), ("q", "p2", 2, 0.5)], "query_id string, chunk_id string, rank int, score double")
    got = [(r.chunk_id, r.score, r.expanded_from) for r in provisions.expand(results, refs, chunks, 2).orderBy("rank").collect()]
    assert got == [("p1", 1.0, None), ("p2", 0.5, None), ("s1", 0.5, "p1"), ("s2", 0.5, "p1"), ("s3", 0.25, "p2")]


def test_citations(spark):
    got = {}
    for r in boosts.citations(S.questions(spark), S.chunks(spark)).orderBy("pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {"q1": ["act:s8(5)"], "q5": ["rules:r4"], "q6": ["rules:sch1:B:11"], "q8": ["act:s9(1)", "act:s9(3)", "rules:r10(1)"]}


def test_a_question_without_a_signal_keeps_its_scores(spark):
    r = S.ranking(spark)
    out = boosts.fuse(r, {"corrections": boosts.corrections(S.questions(spark), r, S.chunks(spark))}, S.chunks(spark))
    kept = {(x.query_id, x.chunk_id): x.score for x in out.collect()}
    assert kept["q1", "act:s8(5)"] == 0.9 and kept["q5", "rules:r4"] != 0.8


def test_covers(spark):
    w = spark.createDataFrame([("d", "w", 100, 200)], "doc_id string, chunk_id string, start int, end int")
    g = spark.createDataFrame([("d", "g", 140, 400)], "doc_id string, chunk_id string, start int, end int")
    assert spans.covering(w, g, 0.5, 50).count() == 1 and spans.covering(w, g, 0.7, 50).count() == 0
    with pytest.raises(ValueError):
        spans.fixed_windows(w, 10, 10)


def test_located_line(spark):
    sp = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(n).alias("line_no")) for o, n in ((0, 4), (10, 5))))
    assert [one(spark, spans.located(sp, F.lit(p), "line_no")) for p in (0, 9, 10, 99, -1)] == [4, 4, 5, 5, None]


@pytest.mark.parametrize("now, want", [(0.75, "pass"), (0.741, "pass"), (0.73, "fail"), (0.9, "improved"), (None, "missing")])
def test_gate(spark, now, want):
    assert one(spark, measures.gate_status(F.lit(0.80), F.lit(now).cast("double"), F.lit(0.05), F.lit(0.01))) == want
    assert one(spark, measures.gate_status(F.lit(None).cast("double"), F.lit(now).cast("double"), F.lit(0.05), F.lit(0.01))) == "new"


def test_cost(spark):
    p = measures.Pricing(3, 15, 1000, 6, 22.5, 1.25, 0.1)
    cost = lambda *t: one(spark, measures.cost_usd(*(F.lit(x) for x in t), p))
    assert cost(100, 10, 50, 20) == pytest.approx((100 + 5 + 25) * 3e-6 + 10 * 15e-6)
    assert cost(1001, 10, 0, 0) == pytest.approx(1001 * 6e-6 + 10 * 22.5e-6)


@pytest.mark.parametrize("strategy, want", [("off", [(0, 1.0)]), ("replace", [(1, 1.0)]), ("fuse", [(0, 1.0), (1, 1.0)]), ("decompose", [(0, 1.0), (2, 0.5), (3, 0.5)]), ("fuse_decompose", [(0, 1.0), (1, 1.0), (2, 0.5), (3, 0.5)])])
def test_strategies(spark, strategy, want):
    q = spark.createDataFrame([("q", "original")], "query_id string, text string")
    r = spark.createDataFrame([("q", "restated", ["one", "two"])], "query_id string, statutory_query string, sub_issues array<string>")
    assert [(x.variant_idx, x.weight) for x in retrieval.variants(q, r, strategy).orderBy("variant_idx").collect()] == want


def test_patches_stop_at_a_place_that_is_not_there(spark):
    chunks = spark.createDataFrame([("d", "c", 1, "may dismay", [(1, 2, 0)])], "doc_id string, chunk_id string, ord int, text string, spans array<struct<page:int,line_no:int,offset:int>>")
    patch = lambda old, page: spark.createDataFrame([("d", 1, "(i)", page, 2, None, old, "shall", "replace")], "doc_id string, seq int, item string, page int, line int, line_end int, old_text string, new_text string, kind string")
    assert segments.apply_patches(chunks, patch("may", 1)).first().text == "shall dismay"
    assert segments.apply_patches(chunks, patch("may", 2)).first().error == "(i)"
    assert segments.apply_patches(chunks, patch("dis", 1)).first().error == "(i)"


def test_labels_and_lines():
    assert [segments.next_label(x) for x in ("a", "z", "za")] == ["b", "za", "zb"]
    assert segments.join_lines(["sub-", "section  (1) ", "", "x"]) == ("sub-section (1) x", [0, 4, 16])
    lead, parts = segments.clauses(["so:", "(a) one", "(i) in", "(b) two"])
    assert lead == ["so:"] and [p[0] for p in parts] == ["a", "b"] and parts[0][1] == ["(a) one", "(i) in"]


def test_caches(spark):
    kv = "key string, ts int, value string"
    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], kv)
    new = spark.createDataFrame([("a", 2, "z")], kv)
    assert {r.key: r.value for r in caches.upsert(t, new).collect()} == {"a": "z", "b": "y"}
    assert {r.key: r.value for r in caches.get_many(t, spark.createDataFrame([("b",), ("c",)], "key string")).collect()} == {"b": "y", "c": None}
    assert one(spark, caches.request_key(F.lit("a  b"))) == one(spark, caches.request_key(F.lit("a b")))
    vec = spark.createDataFrame([("c", [1.0])], "chunk_id string, vector array<double>")
    now = spark.createDataFrame([("c", "t")], "chunk_id string, text string")
    assert caches.index_is_current(vec.withColumn("text_hash", F.xxhash64(F.lit("t"))), now).first().current is True
    assert caches.index_is_current(vec.withColumn("text_hash", F.xxhash64(F.lit("u"))), now).first().current is False
    assert caches.storable(spark.createDataFrame([("end_turn",), ("max_tokens",)], "stop_reason string")).count() == 1


def test_sources(spark, tmp_path):
    good = {"id": "g1", "question": "?", "category": "lookup", "gold_chunk_ids": ["a"], "reference_answer": "x", "answerable": True, "author": "me"}
    (tmp_path / "g.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"odd": 1})]))
    golden, problems = readers.read_golden(spark, str(tmp_path / "g.jsonl"))
    assert golden.count() == 2 and problems.count() == 2
    with pytest.raises(ValueError, match="unknown chunk a"):
        evaluation.checked_golden(golden.limit(1), S.chunks(spark), ["lookup"])
    assert readers.read_requests(spark, str(tmp_path / "none")).count() == 0
    readers.write_chunks(S.chunks(spark), str(tmp_path / "c"), "json")
    back = readers.read_chunks(spark, str(tmp_path / "c"))
    assert back.count() == len(S.CHUNKS) and back.where("corrects is null").count() == 0
    with pytest.raises(ValueError):
        readers.union_corpora([back, back])
    for run, body in (("r1", '{"started_at": "2"}'), ("r2", "{no"), ("r3", '{"started_at": "1"}')):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "results.json").write_text(body)
    assert [r.run_id for r in readers.read_eval_runs(spark, str(tmp_path / "runs")).collect()] == ["r3", "r1"]
    assert readers.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": [1]}) == {"a": {"b": 3, "c": 2}, "d": [1]}
    assert readers.read_json(str(tmp_path / "missing.json")) is None


def test_modes(spark):
    docs = S.chunks(spark)
    vec = docs.select("chunk_id", "ord", "doc_type", "rule", "section", "in_force_date", F.array(F.lit(1.0), F.col("ord").cast("double")).alias("vector"))
    q = S.questions(spark).withColumn("vector", F.array(F.lit(1.0), F.lit(3.0)))
    for mode in ("dense", "bm25", "hybrid"):
        out = ranked(docs, vec, q, Settings(mode=mode, k=3, candidates=5))
        assert out.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5
    with pytest.raises(ValueError):
        ranked(docs, vec, q, Settings(mode="odd"))


def test_stream(spark, sf_dir, tmp_path):
    from rankloom.streaming.requests import over_time

    log = readers.requests_of_events(readers.table(spark, sf_dir, "events"))
    log.repartition(2).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = over_time(stream).writeStream.outputMode("complete").format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("buckets").agg(F.sum("n")).first()[0] == log.count()
