"""The whole retrieval of a table of questions, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boosts, provisions, retrieval
from ..operators.retrieval import Filters
from ..sources.scratch import cut


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid"
    k: int = 5
    candidates: int = 50
    rrf_k: int = 60
    strategy: str = "off"
    weights: dict[str, float] = field(default_factory=dict)
    rerank_top: int = 0
    cross_refs: bool = False
    max_per_chunk: int = 4
    score_factor: float = 0.5
    filters: Filters = Filters()
    as_of: str | None = None


def stage_scores(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, chunk_id, scores): the score that each stage (name, ranking) gave a hit, by the stage's name."""
    out = None
    for name, df in stages:
        part = df.select("query_id", "chunk_id", F.lit(name).alias("stage"), F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    entries = F.array_sort(F.collect_list(F.struct("stage", "score")))
    return out.groupBy("query_id", "chunk_id").agg(F.map_from_entries(entries).alias("scores"))


def hits_json(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, hit): each hit with its whole chunk as JSON."""
    whole = chunks.select("chunk_id", F.struct(*chunks.columns).alias("chunk"))
    shown = [c for c in ("chunk_id", "score", "scores", "expanded_from") if c in results.columns]
    return results.join(whole, "chunk_id").select("query_id", "rank", F.to_json(F.struct(*shown, "chunk"), {"ignoreNullFields": "false"}).alias("hit"))


def ranked(corpus: DataFrame, vectors: DataFrame | None, queries: DataFrame, s: Settings, stages: list | None = None) -> DataFrame:
    """dense, bm25 or both fused: queries (query_id, text, vector). Every list is added to stages by its name."""
    if s.mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {s.mode!r}")
    limit = max(s.candidates, s.k)
    own = s.filters.condition() if s.filters != Filters() else None
    lists = []
    if s.mode != "bm25":
        lists.append(retrieval.dense(vectors, queries, limit, own))
    if s.mode != "dense":
        lists.append(retrieval.bm25(corpus, queries, limit, filters=s.filters if own is not None else None))
    if stages is not None:
        lists = [cut(x) for x in lists]  # read for the fusion and for their scores
        stages += zip(("dense", "bm25") if s.mode == "hybrid" else (s.mode,), lists)
    if len(lists) == 1:
        return lists[0].select("query_id", "chunk_id", "score", "rank")
    return retrieval.rrf(retrieval.as_list(lists[0], 0).unionByName(retrieval.as_list(lists[1], 1)), s.rrf_k, limit)


def retrieve(
    corpus: DataFrame, vectors: DataFrame | None, queries: DataFrame, s: Settings, rewrites: DataFrame | None = None,
    scorer: Callable[[Column, Column], Column] = retrieval.lexical_overlap, with_scores: bool = False,
) -> DataFrame:
    """Rewritten queries are ranked one by one and fused, boosts follow the original question, then a rerank, the cut
    to k and the cross-references. (query_id, chunk_id, score, rank, expanded_from, and with_scores a map of each stage's
    score). scorer(question, document) gives the rerank's scores: any column expression, or a pandas_udf with a model."""
    stages: list | None = [] if with_scores else None
    if s.strategy != "off" and rewrites is not None:
        many = retrieval.variants(queries.select("query_id", "text"), rewrites, s.strategy)
        named = many.withColumn("base", F.col("query_id")).withColumn("query_id", F.concat_ws("#", "query_id", "variant_idx"))
        # All variants are dense-ranked by the question's own vector: offline there is no model to embed new text.
        asked = named.join(queries.select(F.col("query_id").alias("base"), "vector"), "base") if "vector" in queries.columns else named
        each = ranked(corpus, vectors, asked, s).join(named.select("query_id", "base", "variant_idx", "weight"), "query_id")
        rows = each.select(F.col("base").alias("query_id"), F.col("variant_idx").alias("list_idx"), "rank", "chunk_id", "weight")
        out = retrieval.rrf(rows, s.rrf_k, max(s.candidates, s.k))
    else:
        out = ranked(corpus, vectors, queries, s, stages)
    if stages is not None and (s.mode == "hybrid" or s.strategy != "off"):
        out = cut(out)
        stages.append(("rrf", out))
    if s.weights:
        out = cut(out)  # signals, fusion and expansion all read the candidates
        make = {
            "citations": lambda: boosts.citations(queries, corpus),
            "definitions": lambda: boosts.definitions(queries, corpus),
            "commencement": lambda: boosts.commencements(queries, corpus),
            "corrections": lambda: boosts.corrections(queries, out, corpus),
            "links": lambda: boosts.links(out, corpus),
        }
        out = boosts.fuse(out, {n: make[n]() for n, w in s.weights.items() if w > 0}, corpus, s.filters.condition(), s.weights, s.rrf_k)
    if s.weights:
        out = cut(out)
        if stages is not None:
            stages.append(("boost", out))
    if s.rerank_top:
        pairs = out.where(F.col("rank") <= s.rerank_top).join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(corpus.select("chunk_id", "text"), "chunk_id")
        out = retrieval.rerank_head(out, pairs.select("query_id", "chunk_id", scorer(F.col("q"), F.col("text")).alias("new_score")), s.rerank_top).drop("old_rank")
        if stages is not None:
            out = cut(out)
            stages.append(("rerank", out.where(F.col("rank") <= s.rerank_top)))
    out = out.where(F.col("rank") <= s.k).select("query_id", "chunk_id", "score", "rank")
    scored = (lambda df: df.join(stage_scores(stages), ["query_id", "chunk_id"], "left")) if stages is not None else (lambda df: df)
    if not s.cross_refs:
        return scored(out.withColumn("expanded_from", F.lit(None).cast("string")))
    out = cut(out)
    refs = corpus.select("chunk_id", F.posexplode(F.when(F.size("refers_to_provisions") > 0, F.col("refers_to_provisions")).otherwise(F.col("refers_to"))).alias("pos", "label"))
    return scored(provisions.expand(out, refs, corpus, s.max_per_chunk, s.score_factor, s.as_of).select("query_id", "chunk_id", "score", "rank", "expanded_from"))
