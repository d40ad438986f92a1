"""Retrieval metrics, answer scores, coverage, ablations and regression gates.

A null metric does not apply; unmatched gold counts 0; an empty mean is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import gate_status

KS, DEPTH = (1, 3, 5), 10


def retrieval_metrics(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    """For each query with gold (query_id, chunk_id): recall@k, hit@k, mrr, first_gold_rank. Repeated gold counts once."""
    want = gold.select("query_id", "chunk_id").distinct()
    met = want.join(ranking.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")), ["query_id", "chunk_id"], "left")
    cols: list[Column] = []
    for k in ks:
        within = F.count_if(F.col("rank") <= k)
        cols += [F.round(within / F.count("*"), 9).alias(f"recall_{k}"), F.when(within > 0, 1.0).otherwise(0.0).alias(f"hit_{k}")]
    near = F.min(F.when(F.col("rank") <= depth, F.col("rank")))
    return met.groupBy("query_id").agg(F.count("*").alias("n_gold"), *cols, F.round(F.coalesce(1 / near, F.lit(0.0)), 9).alias("mrr"), near.alias("first_gold_rank"))


def by_category(items: DataFrame, metrics: list[str], categories: DataFrame | None = None) -> DataFrame:
    """Means of the metrics for each category and over all (category null), with the n behind each."""
    cols = [x for m in metrics for x in (F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"n_{m}"))]
    grouped = items.groupingSets([["category"], []], "category").agg(F.grouping("category").alias("overall"), F.count("*").alias("n"), *cols)
    if categories is None:
        return grouped
    every = categories.select("category", F.lit(0).alias("overall")).unionByName(categories.limit(1).select(F.lit(None).cast("string").alias("category"), F.lit(1).alias("overall")))
    out = every.alias("e").join(grouped.alias("g"), F.expr("e.overall = g.overall and e.category <=> g.category"), "left")
    counted = ["n", *(f"n_{m}" for m in metrics)]
    return out.select("e.category", "e.overall", *(F.coalesce(F.col(f"g.{c}"), F.lit(0)).alias(c) for c in counted), *(F.col(f"g.{m}").alias(m) for m in metrics))


def answer_scores(items: DataFrame, judged: DataFrame, threshold: int = 4) -> DataFrame:
    """Over items (item_id, category, refused, error) and judgements (item_id, metric, value, failed).

    Means and pass rates of faithfulness and relevance, shares of right refusals and resisted injections, failed
    judge calls, and how often an answer without an error was a refusal.
    """
    value = lambda m: F.max(F.when((F.col("metric") == m) & ~F.col("failed"), F.col("value")))
    wide = judged.groupBy("item_id").agg(*(value(m).alias(m) for m in ("faithfulness", "relevance", "refusal", "injection")), F.count_if("failed").alias("failed"))
    rows = items.join(wide, "item_id", "left")
    passed = lambda m: F.avg(F.when(F.col(m).isNotNull(), F.when(F.col(m) >= threshold, 1.0).otherwise(0.0)))
    cols = []
    for m in ("faithfulness", "relevance"):
        cols += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(passed(m), 6).alias(f"{m}_pass_rate"), F.count(m).alias(f"{m}_n")]
    for m, name in (("refusal", "refusal_correctness"), ("injection", "injection_resisted")):
        cols += [F.round(F.avg(m), 6).alias(name), F.count(m).alias(f"{m}_n")]
    cols += [F.coalesce(F.sum("failed"), F.lit(0)).alias("judge_failed"), F.round(F.avg(F.when(F.col("error").isNull(), F.col("refused").cast("double"))), 6).alias("refusal_rate")]
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count("error").alias("errors"), *cols)


def judge_status(items: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: scored, failed, unjudged, status (ok, degraded, unavailable)."""
    a = judged.agg(F.count_if(~F.col("failed")).alias("scored"), F.count_if("failed").alias("failed"))
    b = items.agg(F.count("*").alias("n"), F.count("error").alias("unjudged"))
    status = F.when((F.col("n") > 0) & (F.col("scored") == 0), "unavailable").when((F.col("failed") > 0) | (F.col("unjudged") > 0), "degraded").otherwise("ok")
    return a.crossJoin(b).select("scored", "failed", "unjudged", status.alias("status"))  # two rows of totals


def wanted_metrics(items: DataFrame, injection_categories: list[str]) -> DataFrame:
    """(item_id, metric) that a judge is asked for: items (item_id, category, answerable, canned)."""
    asked = F.array_compact(
        F.array(
            F.lit("refusal"),
            F.when(F.col("category").isin(injection_categories), F.lit("injection")),
            F.when(~F.col("canned"), F.lit("faithfulness")),
            F.when(F.col("answerable"), F.lit("relevance")),
        )
    )
    return items.select("item_id", F.explode(asked).alias("metric"))


def missing_reason(scores: DataFrame) -> DataFrame:
    """Why a category's faithfulness is empty: rows as answer_scores gives them."""
    reason = (
        F.when(F.col("faithfulness_n") > 0, F.lit(None).cast("string"))
        .when(F.col("n") == 0, "no items")
        .when(F.col("errors") == F.col("n"), "every item failed")
        .when(F.col("judge_failed") > 0, "the judge failed")
        .otherwise("does not apply")
    )
    return scores.select("category", reason.alias("reason"))


def uncovered(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    return chunks.join(gold.select("chunk_id").distinct(), "chunk_id", "left_anti")


def coverage(chunks: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """For each group: chunks in all, covered by gold, uncovered."""
    marked = chunks.select("chunk_id", group).join(gold.select("chunk_id").distinct().withColumn("hit", F.lit(1)), "chunk_id", "left")
    return marked.groupBy(group).agg(F.count("*").alias("total"), F.count("hit").alias("covered"), (F.count("*") - F.count("hit")).alias("uncovered"))


def golden_problems(golden: DataFrame, chunks: DataFrame, categories: list[str]) -> DataFrame:
    """(id, problem) of every rule that an item breaks; all are found before any is reported."""
    one = lambda cond, what: golden.where(cond).select("id", F.lit(what).alias("problem"))
    listed = golden.select("id", F.explode("gold_chunk_ids").alias("chunk_id"))
    unknown = listed.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("id", F.concat(F.lit("unknown chunk "), "chunk_id").alias("problem"))
    repeated = listed.groupBy("id", "chunk_id").count().where("count > 1").select("id", F.concat(F.lit("repeated chunk "), "chunk_id").alias("problem"))
    twice = golden.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    no_gold = F.size(F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))) == 0
    return (
        one(~F.col("category").isin(categories), "unknown category")
        .unionByName(one((F.col("category") != "unanswerable") & F.col("answerable") & no_gold, "answerable without gold"))
        .unionByName(one((F.col("category") == "unanswerable") & F.col("answerable"), "unanswerable marked answerable"))
        .unionByName(unknown).unionByName(repeated).unionByName(twice)
    )


def checked_golden(golden: DataFrame, chunks: DataFrame, categories: list[str]) -> DataFrame:
    """The golden set, or one ValueError that lists every problem."""
    found = golden_problems(golden, chunks, categories).orderBy("id", "problem").collect()  # a hand-written set
    if found:
        raise ValueError("\n".join(f"{r.id}: {r.problem}" for r in found))
    return golden


def ablation(rankings: DataFrame, gold: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means of each variant, by category and over all: rankings (variant, query_id, chunk_id, rank)."""
    named = F.concat_ws("\u0001", "variant", "query_id")
    names = rankings.select("variant").distinct()
    want = gold.join(F.broadcast(names))  # a variant a row of a configured grid
    scores = retrieval_metrics(rankings.select(named.alias("query_id"), "chunk_id", "rank"), want.select(named.alias("query_id"), "chunk_id"), ks)
    each = scores.withColumns({"variant": F.split("query_id", "\u0001")[0], "item": F.split("query_id", "\u0001")[1]}).join(items.select(F.col("query_id").cast("string").alias("item"), "category"), "item")
    cols = [*(f"recall_{k}" for k in ks), f"hit_{ks[-1]}", "mrr"]
    return each.groupingSets([["variant", "category"], ["variant"]], "variant", "category").agg(F.grouping("category").alias("overall"), F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in cols))


def gates(baseline: DataFrame, current: DataFrame, limits: DataFrame) -> DataFrame:
    """A check a gated metric: baseline and current (metric, value), limits (metric, max_drop, tolerance)."""
    b, c = (df.select("metric", F.col("value").alias(n)) for df, n in ((baseline, "baseline"), (current, "current")))
    rows = limits.join(b, "metric", "left").join(c, "metric", "left")
    status = gate_status(F.col("baseline"), F.col("current"), F.col("max_drop"), F.col("tolerance"))
    return rows.select("metric", "baseline", "current", F.round(F.col("current") - F.col("baseline"), 9).alias("delta"), status.alias("status"), status.isin("fail", "missing").alias("failed"))


def snapshot(results: DataFrame, paths: dict[str, str], column: str = "results") -> DataFrame:
    """(metric, value) from JSON results by dotted path; what is not a number is null, true and false are 1 and 0."""
    parts = [F.struct(F.lit(m).alias("metric"), F.get_json_object(column, "$" + "".join(f"['{p}']" for p in path.split("."))).alias("raw")) for m, path in paths.items()]
    each = results.select(F.explode(F.array(*parts)).alias("p")).select("p.metric", "p.raw")
    return each.select("metric", F.when(F.col("raw") == "true", 1.0).when(F.col("raw") == "false", 0.0).otherwise(F.col("raw").try_cast("double")).alias("value"))


def history(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run_id, metric, value) of wide runs, without nulls; `pivoted` turns it back."""
    return runs.unpivot(["run_id"], metrics, "metric", "value").where("value is not null")


def pivoted(long: DataFrame, metrics: list[str]) -> DataFrame:
    return long.groupBy("run_id").pivot("metric", metrics).agg(F.first("value"))


def labels_collide(points: DataFrame, min_gap: float) -> DataFrame:
    """Whether the last values of any two series (chart, series, x, y) lie closer than min_gap of the chart's range."""
    last = points.groupBy("chart", "series").agg(F.max_by("y", "x").alias("y"))
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("chart").orderBy("y"))
    span = points.groupBy("chart").agg((F.max("y") - F.min("y")).alias("span"))
    return last.withColumn("gap", gap).join(span, "chart").groupBy("chart").agg(F.coalesce(F.bool_or(F.col("gap") < F.col("span") * min_gap), F.lit(False)).alias("collide"))


def window_metrics(ranking: DataFrame, covers: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    """Metrics of ranked windows, each of which may cover several gold chunks: covers (chunk_id, gold_id).

    recall counts the distinct gold that the first k cover; hit is for the last k; mrr is of the first window that
    covers any.
    """
    want = gold.select("query_id", F.col("chunk_id").alias("gold_id")).distinct()
    found = ranking.join(covers.select("chunk_id", "gold_id"), "chunk_id").join(want, ["query_id", "gold_id"])
    best = found.groupBy("query_id", "gold_id").agg(F.min("rank").alias("rank"))
    return retrieval_metrics(best.withColumnRenamed("gold_id", "chunk_id"), gold, ks, depth)


def context_recall(context: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, context_recall): the share of a query's gold among the chunks that its answer was given."""
    want = gold.select("query_id", "chunk_id").distinct()
    got = want.join(context.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return got.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 9).alias("context_recall"))


def headline(overall: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) of one wide row, without nulls."""
    return overall.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("m.*").where("value is not null")


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Token counters added up, with the total of input and of everything."""
    parts = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    out = calls.groupBy(*by).agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in parts))
    total_in = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return out.withColumn("total_input", total_in).withColumn("total", total_in + F.col("output_tokens"))
