"""An evaluation of a golden set: retrieve, answer with the stub, measure, compare with a baseline."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, evaluation
from ..sources.scratch import cut
from .retrieve import Settings, retrieve

#: Exit codes of a run.
OK, INVALID_GOLDEN, OVER_BUDGET, JUDGE_UNAVAILABLE, DEGRADED = range(5)


def digest(*parts) -> str:
    """sha256 of the parts as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def selected(golden: DataFrame, categories: list[str] | None = None, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = golden.where(F.col("category").isin(categories)) if categories else golden
    out = out.where(F.col("id").isin(ids)) if ids else out
    return out.orderBy("id").limit(limit) if limit else out


def run(corpus: DataFrame, vectors: DataFrame | None, golden: DataFrame, s: Settings, today: str, depth: int = evaluation.DEPTH) -> DataFrame:
    """A row an item: id, category, as_of, retrieval metrics (null without gold), context_recall, refused, citations.

    Metrics are of the ranking without cross-references; the answer is given what they add.
    """
    queries = golden.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    gold = golden.select(F.col("id").alias("query_id"), F.explode("gold_chunk_ids").alias("chunk_id"))
    plain = retrieve(corpus, vectors, queries, replace(s, k=max(depth, s.k), cross_refs=False))
    metrics = evaluation.retrieval_metrics(plain, gold, depth=depth)
    given = cut(retrieve(corpus, vectors, queries, s))
    stub = answers.stub_answers(answers.context(given, corpus, today))
    checked = answers.valid_citations(stub.withColumnRenamed("query_id", "answer_id"), given.select(F.col("query_id").alias("answer_id"), "chunk_id"))
    out = golden.select(F.col("id").alias("query_id"), "category", F.coalesce("as_of_date", F.lit(today).cast("date")).alias("as_of"))
    out = out.join(metrics, "query_id", "left").join(evaluation.context_recall(given, gold), "query_id", "left")
    return out.join(checked.withColumnRenamed("answer_id", "query_id"), "query_id", "left").withColumn("refused", F.coalesce("refused", F.lit(True)))


@dataclass(frozen=True)
class Variant:
    """One row of an ablation: how to retrieve, over which corpus (by name), and from which rewrites."""

    name: str
    settings: Settings
    corpus: str = "structure"


def grid(corpora: dict[str, tuple[DataFrame, DataFrame | None]], variants: list[Variant], golden: DataFrame, covers: dict[str, DataFrame] | None = None, rewrites: DataFrame | None = None, ks: tuple[int, ...] = evaluation.KS, depth: int = evaluation.DEPTH) -> DataFrame:
    """Means of each variant by category and over all, on the items that have gold.

    corpora: name to (chunks, vectors). covers: for a corpus of other chunks than the golden ones, (chunk_id, gold_id).
    A variant boosts only if its settings say so; cross-references are off. One plan a variant: there are few.
    """
    items = golden.where(F.size("gold_chunk_ids") > 0).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "category", "gold_chunk_ids")
    gold = items.select("query_id", F.explode("gold_chunk_ids").alias("chunk_id"))
    out = None
    for v in variants:
        chunks, vectors = corpora[v.corpus]
        hits = cut(retrieve(chunks, vectors, items.select("query_id", "text"), replace(v.settings, k=max(depth, *ks), cross_refs=False), rewrites))
        if covers and v.corpus in covers:
            scores = evaluation.window_metrics(hits, covers[v.corpus], gold, ks, depth)
        else:
            scores = evaluation.retrieval_metrics(hits, gold, ks, depth)
        part = scores.join(items.select("query_id", "category"), "query_id").withColumn("variant", F.lit(v.name))
        out = part if out is None else out.unionByName(part)
    cols = [*(f"recall_{k}" for k in ks), f"hit_{ks[-1]}", "mrr"]
    return out.groupingSets([["variant", "category"], ["variant"]], "variant", "category").agg(F.grouping("category").alias("overall"), F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in cols))


def exit_code(problems: int, budget_left: bool, judge_status: str) -> int:
    if problems:
        return INVALID_GOLDEN
    if not budget_left:
        return OVER_BUDGET
    return {"unavailable": JUDGE_UNAVAILABLE, "degraded": DEGRADED}.get(judge_status, OK)


def markdown(rows: DataFrame, digits: int = 2) -> str:
    """A small table as text; null is a dash."""
    shown = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows.collect()])


def write_report(by_category: DataFrame, folder: str) -> None:
    """results.json and summary.md of a run's few aggregate rows."""
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/results.json", "w", encoding="utf-8") as f:
        json.dump([r.asDict(True) for r in by_category.collect()], f, default=str)
    with open(f"{folder}/summary.md", "w", encoding="utf-8") as f:
        f.write(markdown(by_category) + "\n")
