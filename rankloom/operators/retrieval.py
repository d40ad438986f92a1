"""Lexical and dense ranking of a corpus for a table of queries, and fusion of rankings.

Corpora have (chunk_id, ord, ...), queries (query_id, text, ...). Rankings are (query_id, chunk_id, score, rank).
Scores are rounded to SCORE_DIGITS before ranking so that ties do not hang on the order of summation; ties go to
the smaller ord. Query tables are small beside the corpus; they are broadcast up to MAX_BROADCAST_TERMS terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, text
from ..sources.scratch import cut

SCORE_DIGITS = 6
MAX_BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class Filters:
    """Metadata conditions; an empty or missing list lets everything pass."""

    doc_type: tuple[str, ...] = ()
    rule: tuple[str, ...] = ()
    section: tuple[str, ...] = ()
    in_force_on: date | None = None

    def condition(self) -> Column:
        parts = [F.col(name).isin(list(getattr(self, name))) for name in ("doc_type", "rule", "section") if getattr(self, name)]
        if self.in_force_on:
            parts.append(F.col("in_force_date") <= F.lit(self.in_force_on))
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    def date_only(self) -> "Filters":
        return Filters(in_force_on=self.in_force_on)

    @classmethod
    def from_config(cls, cfg: dict) -> "Filters":
        """Values may be one string or a list; in_force_only needs today."""
        many = lambda v: () if v is None else tuple(map(str, v)) if isinstance(v, (list, tuple)) else (str(v),)
        today = date.fromisoformat(str(cfg["today"])) if cfg.get("today") else date.today()
        return cls(many(cfg.get("doc_type")), many(cfg.get("rule")), many(cfg.get("section")), today if cfg.get("in_force_only") else None)


def sent(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame that has at most MAX_BROADCAST_TERMS rows; larger ones are left to the join's shuffle."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_TERMS else df


def top(scored: DataFrame, limit: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best `limit` rows a query, numbered from 1. Spark keeps only `limit` rows a partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len."""
    sized = corpus.select(F.size(text.tokens(F.col("text"))).alias("n"))
    return sized.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def document_frequency(corpus: DataFrame) -> DataFrame:
    """(term, df): each document's distinct terms, summed before the shuffle."""
    return corpus.select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times); a repeated query word counts again."""
    each = queries.select("query_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def corpus_terms(corpus: DataFrame) -> DataFrame:
    """(term, df, n_words) in one reading of the corpus: each term's documents; in the row of the null term the number of
    documents and of their words."""
    words = corpus.select(text.tokens(F.col("text")).alias("w"))
    each = words.select(F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("w").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("n_words"))


def bm25(corpus: DataFrame, queries: DataFrame, limit: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, filters: Filters | None = None) -> DataFrame:
    """Okapi BM25, top `limit` a query, of positive scores.

    Statistics are those of the whole corpus, filters apply after scoring. A negative inverse document frequency
    becomes `floor` times the mean over all terms. The corpus is read once for the statistics and once for the scores;
    for these its texts are dealt by chunk once, and all further sums are taken where a chunk lies.
    """
    terms = cut(corpus_terms(corpus))
    stats = terms.where("term is null").select(F.col("df").alias("n_docs"), (F.col("n_words") / F.col("df")).alias("avg_len"))
    df = terms.where("term is not null").crossJoin(F.broadcast(stats))  # one row of statistics
    raw = df.select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    asked = query_terms(queries)
    n_asked = asked.count()
    idf = raw.join(sent(asked.select("term").distinct(), n_asked), "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = cut(idf.select("term", F.when(F.col("raw") < 0, F.lit(floor) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")))
    kept = corpus.where(filters.condition()) if filters else corpus
    words = kept.select("chunk_id", "ord", "text").repartition("chunk_id").select("chunk_id", "ord", text.tokens(F.col("text")).alias("words"))
    hits = words.select("chunk_id", "ord", F.size("words").alias("len"), F.explode("words").alias("term"))
    hits = hits.join(sent(idf, n_asked), "term").groupBy("chunk_id", "ord", "len", "term", "idf").agg(F.count("*").alias("tf"))
    share = F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg_len")
    part = F.col("times") * F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * share)
    scored = hits.join(sent(asked, n_asked), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "chunk_id", "ord").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    return top(scored.where("score > 0"), limit)


#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 64 << 20


def dense(vectors: DataFrame, queries: DataFrame, limit: int, filters: Column | None = None) -> DataFrame:
    """Cosine top `limit`: vectors (chunk_id, ord, vector), queries (query_id, vector).

    A stated query set against all rows: queries are broadcast, in blocks of about BLOCK_BYTES, and scored where the
    vectors lie; no vector moves.
    """
    n_bytes = queries.agg(F.sum(F.size("vector") * 8 + 100)).first()[0] or 0
    n_blocks = 1 + n_bytes // BLOCK_BYTES
    unit = lambda df, name: df.withColumn(name, F.transform("vector", lambda x: x.cast("double") / measures.norm(F.col("vector")))).drop("vector")
    rows = unit(vectors if filters is None else vectors.where(filters), "v")
    asked, out = unit(queries.select("query_id", "vector"), "q"), None
    for k in range(n_blocks):
        some = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == k)
        scored = rows.crossJoin(F.broadcast(some)).select("query_id", "chunk_id", "ord", F.round(measures.dot(F.col("v"), F.col("q")), SCORE_DIGITS).alias("score"))
        best = top(scored, limit)
        out = best if out is None else out.unionByName(best)
    return out


def hash_vectors(rows: DataFrame, dim: int = 256) -> DataFrame:
    """Sparse hash embeddings (chunk_id, dim, weight): token counts by hash, scaled to length 1."""
    each = rows.select("chunk_id", F.explode(text.tokens(F.col("text"), ())).alias("t")).select("chunk_id", text.hash_dimension(F.col("t"), dim).alias("dim"))
    counts = each.groupBy("chunk_id", "dim").agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("chunk_id")))
    return counts.select("chunk_id", "dim", (F.col("n") / length).alias("weight"))


def rrf(rankings: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, list_idx, rank, chunk_id, weight).

    A list that names a chunk twice counts it twice. Ties go to what appears first, in list order.
    """
    first = F.min(F.struct("list_idx", "rank"))
    fused = rankings.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 9).alias("score"), first.alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    out = fused.withColumn("rank", F.row_number().over(w)).drop("first")
    return out.where(F.col("rank") <= limit) if limit else out


def as_list(ranking: DataFrame, idx: int, weight: float = 1.0) -> DataFrame:
    return ranking.select("query_id", F.lit(idx).alias("list_idx"), "rank", "chunk_id", F.lit(float(weight)).alias("weight"))


def rerank_head(ranking: DataFrame, rescored: DataFrame, top_n: int) -> DataFrame:
    """The first top_n rows in the order of rescored (query_id, chunk_id, new_score); the rest follow as they were."""
    joined = ranking.join(rescored, ["query_id", "chunk_id"], "left")
    head = (F.col("rank") <= top_n) & F.col("new_score").isNotNull()
    w = Window.partitionBy("query_id").orderBy(F.desc(head), F.desc(F.when(head, F.col("new_score"))), "rank")
    return joined.select("query_id", "chunk_id", F.when(head, F.col("new_score")).otherwise(F.col("score")).alias("score"), F.col("rank").alias("old_rank"), F.row_number().over(w).alias("rank"))


def lexical_overlap(question: Column, document: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's terms that the document holds."""
    q, d = F.array_distinct(text.tokens(question)), F.array_distinct(text.tokens(document))
    return F.round(F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)), SCORE_DIGITS)


def variants(queries: DataFrame, rewrites: DataFrame, strategy: str, sub_issue_weight: float = 1.0, max_sub_issues: int = 4) -> DataFrame:
    """The weighted query list of a strategy: off, replace, fuse, decompose or fuse_decompose.

    rewrites: (query_id, statutory_query, sub_issues). The original comes first; sub-issues share one weight; blank
    and repeated texts are dropped, the first stays.
    """
    if strategy not in ("off", "replace", "fuse", "decompose", "fuse_decompose"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = queries.join(rewrites, "query_id", "left")
    one = lambda i, c, w: F.struct(F.lit(i).alias("i"), c.alias("text"), w.alias("weight"))
    subs = F.slice(F.coalesce("sub_issues", F.array().cast("array<string>")), 1, max_sub_issues)
    restated = F.coalesce("statutory_query", "text")
    parts = []
    if strategy != "replace":
        parts.append(F.array(one(0, F.col("text"), F.lit(1.0))))
    if strategy == "replace":
        parts.append(F.array(one(1, restated, F.lit(1.0))))
    if strategy.startswith("fuse"):
        parts.append(F.array(one(1, restated, F.lit(1.0))))
    if strategy.endswith("decompose"):
        parts.append(F.transform(subs, lambda s, i: F.struct((i + 2).alias("i"), s.alias("text"), (F.lit(sub_issue_weight) / F.size(subs)).alias("weight"))))
    each = rows.select("query_id", F.explode(F.concat(*parts)).alias("v")).select("query_id", F.col("v.i").alias("variant_idx"), F.trim("v.text").alias("text"), "v.weight").where("text != ''")
    w = Window.partitionBy("query_id", "text").orderBy("variant_idx")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
