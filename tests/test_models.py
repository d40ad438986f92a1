"""Model hooks, printed pages' settings, and what a run leaves behind."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions.measures import Pricing
from rankloom.operators import evaluation, models, segments
from rankloom.plans import evaluate, records, sample
from rankloom.plans.retrieve import Settings, hits_json, retrieve
from rankloom.sources import readers

PRICES = Pricing(input=1.0, output=2.0, long_context_threshold=10**9, long_input=1.0, long_output=2.0)
CACHE = f"key string, {models.RESPONSE}"


def echoing():
    """Made here, so that it is sent to workers by value."""
    return lambda requests: [{"text": r["user"].upper(), "stop_reason": "max_tokens" if "cut" in r["user"] else "end_turn", "input_tokens": 1000, "output_tokens": 500} for r in requests]


def test_cached_calls(spark):
    echo = echoing()
    calls = spark.createDataFrame([(i, "s", u, "{}") for i, u in enumerate(["a", "b", "a", "cut"])], "call_id int, system string, user string, schema string")
    none = spark.createDataFrame([], CACHE)
    got, fresh = models.cached_calls(calls, none, echo, "m", prices=PRICES, cap=100.0)
    assert sorted((r.call_id, r.text, r.cached) for r in got.collect()) == [(0, "A", False), (1, "B", False), (2, "A", False), (3, "CUT", False)]
    assert sorted(r.text for r in fresh.collect()) == ["A", "B"]
    again, _ = models.cached_calls(calls, fresh, echo, "m")
    assert {r.call_id: r.cached for r in again.collect()} == {0: True, 1: True, 2: True, 3: False}
    other, _ = models.cached_calls(calls, fresh, echo, "m", '{"temperature": 1}')
    assert other.where("cached").count() == 0
    many = spark.range(40).select(F.col("id").alias("call_id"), F.lit("s").alias("system"), F.concat(F.lit("u"), "id").alias("user"), F.lit("{}").alias("schema"))
    with pytest.raises(models.OverBudget):
        models.cached_calls(many, none, echo, "m", prices=PRICES, cap=0.003, block=1)
    with pytest.raises(Exception, match="responses"):
        models.generated(calls.withColumn("key", F.col("user")), lambda rs: rs[:-1]).count()


def test_preflight_and_rewrites_that_must_not_fail(spark):
    one = spark.createDataFrame([(1, "relevance", "s", "u", "{}")], "item_id int, metric string, system string, user string, schema string")
    models.preflight(one, lambda rs: [{"text": '{"reasoning": "r", "score": 3}'} for _ in rs])
    with pytest.raises(models.JudgeUnavailable):
        models.preflight(one, lambda rs: [{"text": '{"reasoning": "r", "score": 9}'} for _ in rs])
    bad = spark.createDataFrame([(1, "x", "end_turn")], "query_id int, text string, stop_reason string")
    with pytest.raises(Exception, match="query rewrite failed"):
        models.rewritten(bad, fallback=False).collect()


def test_baseline(spark, tmp_path):
    run = lambda v: spark.createDataFrame([(json.dumps({"overall": {"mrr": v}}),)], "results string")
    limits = spark.createDataFrame([("mrr", 0.05, 0.01)], "metric string, max_drop double, tolerance double")
    target, paths = str(tmp_path / "b" / "baseline.json"), {"mrr": "overall.mrr"}
    write = lambda v, **kw: records.write_baseline(run(v), paths, limits, target, kw.pop("reason", "why"), "me", **kw)
    for kw in ({"reason": " "}, {"errors": 1}):
        with pytest.raises(records.Refused):
            write(0.8, **kw)
    assert "no baseline yet" in write(0.8, dry_run=True) and not (tmp_path / "b").exists()
    write(0.8)
    assert json.load(open(target))["metrics"] == {"mrr": 0.8} and json.load(open(target))["reason"] == "why"
    with pytest.raises(records.Refused):
        write(0.7)
    said = write(0.7, allow_regression=True, errors=2, allow_errors=True)
    assert "## ❌ Eval gate failed" in said and "| **mrr** | 0.800 | 0.700 | -0.100 | 0.05 (+0.01) | ❌ |" in said
    assert "✅ ⬆" in write(0.9) and json.load(open(target))["metrics"] == {"mrr": 0.9}


def test_configurations_prompts_and_sources(tmp_path, monkeypatch):
    for name, text in (("a.json", '{"x": {"y": 1, "z": [1]}, "k": 2}'), ("b.json", '{"system": {"x": {"z": [2]}}, "eval": {"k": 3}}'), ("p.txt", "Ask $q"), ("s.json", '{"type": "object"}')):
        (tmp_path / name).write_text(text)
    path = lambda n: str(tmp_path / n)
    assert records.load_config(path("a.json"), [path("b.json")], "system") == {"x": {"y": 1, "z": [2]}, "k": 2}
    with pytest.raises(FileNotFoundError):
        records.load_config(path("a.json"), [path("none.json")])
    prompts = records.load_prompts({"user": path("p.txt"), "schema": path("s.json")})
    assert prompts["user"].substitute(q="why") == "Ask why" and prompts["schema"] == {"type": "object"}
    records.check_sources(["a"], ["b"])
    with pytest.raises(ValueError):
        records.check_sources(["a", "b"], ["b"])
    monkeypatch.setenv("GIT_SHA", "abc")
    assert records.git_state() == ("abc", None)
    monkeypatch.delenv("GIT_SHA")
    assert records.git_state(str(tmp_path)) == ("unknown", None)


def test_index_is_built_when_stale(spark, tmp_path):
    chunks = sample.chunks(spark)
    embed = lambda c: c.select("chunk_id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))
    path = str(tmp_path / "index")
    assert records.build_index(chunks, embed, path) and not records.build_index(chunks, embed, path)
    assert records.build_index(chunks.withColumn("text", F.upper("text")), embed, path)
    assert spark.read.parquet(path).count() == chunks.count()


def test_chunk_files(spark, tmp_path):
    rows = [{"chunk_id": f"c{i}", "text": "t"} for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    got = readers.read_chunks(spark, str(tmp_path / "a.jsonl")).orderBy("ord").collect()
    assert [r.chunk_id for r in got] == [f"c{i}" for i in range(5)]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows + rows[:1])))
    with pytest.raises(ValueError, match="c0"):
        readers.read_chunks(spark, str(tmp_path / "b.jsonl"))


def test_a_missing_start_raises(spark):
    lines = spark.createDataFrame([("d", 1, "x"), ("d", 2, "END")], "doc_id string, ord int, text string")
    with pytest.raises(Exception, match="no line with"):
        segments.body(lines, "START", "END").collect()


def test_stage_scores_and_scorer(spark):
    chunks, asked = sample.chunks(spark), sample.questions(spark)
    s = Settings(mode="bm25", k=3, candidates=5, rerank_top=2)
    got = retrieve(chunks, None, asked, s, scorer=lambda q, d: F.length(d).cast("double"), with_scores=True)
    rows = got.collect()
    assert rows and all(set(r.scores) <= {"bm25", "rerank"} and "bm25" in r.scores for r in rows)
    assert all(r.score == r.scores["rerank"] for r in rows if r["rank"] <= 2)
    hit = json.loads(hits_json(got, chunks).where("rank = 1").first().hit)
    assert hit["chunk"]["chunk_id"] == hit["chunk_id"] and "bm25" in hit["scores"]


def test_grid(spark):
    golden = spark.createDataFrame([("q1", "What does Section 8(5) ask of a Data Fiduciary?", "lookup", ["act:s8(5)"]), ("q9", "x", "lookup", [])], "id string, question string, category string, gold_chunk_ids array<string>")
    chunks = sample.chunks(spark)
    halves = chunks.withColumn("chunk_id", F.concat(F.lit("w:"), "chunk_id"))
    covers = halves.select("chunk_id", F.substring("chunk_id", 3, 100).alias("gold_id"))
    variants = [evaluate.Variant("plain", Settings(mode="bm25")), evaluate.Variant("boosted", Settings(mode="bm25", weights={"citations": 1.0})), evaluate.Variant("fixed", Settings(mode="bm25"), "fixed")]
    got = {(r.variant, r.category): r for r in evaluate.grid({"structure": (chunks, None), "fixed": (halves, None)}, variants, golden, {"fixed": covers}).collect()}
    assert set(got) == {(v, c) for v in ("plain", "boosted", "fixed") for c in ("lookup", None)}
    assert got["boosted", None].mrr == 1.0 and got["fixed", None].mrr == got["plain", None].mrr and got["plain", None].n == 1
    assert evaluation.KS
