"""Queries over the supplied tables: ranking, evaluation, request logs and spans. Each has its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, text
from ..operators import caches, evaluation, requests, retrieval, spans
from ..operators.retrieval import Filters
from ..sources.readers import requests_of_events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: t NOT IN ({STOP}))"


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("doc_type"), F.col("source").alias("doc_id"), "text")


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_sql(limit: int, docs: str = "SELECT * FROM documents", asked: str = "SELECT item_id AS query_id, text FROM benchmark", keep: str = "true", b: float = 0.75, p: str = "") -> str:
    """Common table expressions that end in `{p}bm25`."""
    return f"""{p}docs AS ({docs}), {p}toks AS (SELECT doc_id, lang, {TOK} AS w FROM {p}docs),
    {p}stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM {p}toks),
    {p}df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM {p}toks) GROUP BY term),
    {p}raw AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM {p}df, {p}stats),
    {p}idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
    {p}asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOK}) AS term FROM ({asked})) GROUP BY ALL),
    {p}tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM {p}toks WHERE {keep}) GROUP BY ALL),
    {p}scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * ({1 - b} + {b} * len / avg_len))), 6) AS score
        FROM {p}tf JOIN {p}idf USING (term) JOIN {p}asked USING (term), {p}stats GROUP BY ALL HAVING score > 0),
    {p}bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}scored) WHERE rank <= {limit})"""


@query(f"SELECT lang, count(*) AS n_docs, sum(len({TOK}))::BIGINT AS n_tokens, sum(len(list_distinct({TOK})))::BIGINT AS n_distinct FROM documents GROUP BY lang")
def tokenize_stats(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(t)).alias("n_tokens"), F.sum(F.size(F.array_distinct(t))).alias("n_distinct"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOK})), 6) AS avg_len FROM documents")
def corpus_stats(spark, d):
    return retrieval.corpus_stats(corpus(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOK})) AS term FROM documents) GROUP BY term")
def document_frequency(spark, d):
    return retrieval.document_frequency(corpus(spark, d))


@query(f"WITH {bm25_sql(5)} SELECT query_id, chunk_id, rank::INTEGER AS rank, score FROM bm25")
def bm25_topk(spark, d):
    return retrieval.bm25(corpus(spark, d), questions(spark, d), 5).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH {bm25_sql(5, keep='''lang IN ('en', 'de')''')} SELECT query_id, chunk_id, rank::INTEGER AS rank, score FROM bm25")
def bm25_filtered(spark, d):
    return retrieval.bm25(corpus(spark, d), questions(spark, d), 5, filters=Filters(doc_type=("en", "de"))).select("query_id", "chunk_id", "rank", "score")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), "label")


def vector_queries(v: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def dense_sql(limit: int, keep: str = "true", asked: str = "vec_id % 100 = 0") -> str:
    return f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE {keep.replace('label', 'e.label')} AND {asked.replace('vec_id', 'q.vec_id')}) WHERE rank <= {limit})"""


@query(f"WITH {dense_sql(10)} SELECT query_id, chunk_id, rank::INTEGER AS rank, score FROM dense")
def dense_cosine_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.dense(v, vector_queries(v), 10).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH {dense_sql(10, 'label IN (1, 2)')} SELECT query_id, chunk_id, rank::INTEGER AS rank, score FROM dense")
def dense_filtered(spark, d):
    v = vectors(spark, d)
    return retrieval.dense(v, vector_queries(v), 10, F.col("label").isin(1, 2)).select("query_id", "chunk_id", "rank", "score")


@query("""WITH t AS (SELECT item_id, md5(t) AS m FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM benchmark)),
    c AS (SELECT item_id, (('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::BIGINT % 256)::INTEGER AS dim, count(*) AS n FROM t GROUP BY ALL)
    SELECT item_id AS chunk_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS weight FROM c""")
def hash_embedding(spark, d):
    return retrieval.hash_vectors(questions(spark, d).withColumnRenamed("query_id", "chunk_id")).withColumn("weight", F.round("weight", 9))


def hybrid_parts(spark, d, limit: int) -> tuple[DataFrame, DataFrame]:
    """Both rankings: BM25 over every document and question, dense over the documents and questions that have a vector
    (a question's is that of its own id). What has none is ranked by BM25 alone."""
    v, docs, q = vectors(spark, d), corpus(spark, d), questions(spark, d)
    asked = q.join(v.select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")
    own = v.join(docs.select("chunk_id"), "chunk_id", "left_semi")
    return retrieval.dense(own, asked, limit), retrieval.bm25(docs, q, limit)


def hybrid_sql(limit: int, final: int) -> str:
    return f"""WITH {bm25_sql(limit)}, {dense_sql(limit, "e.vec_id IN (SELECT doc_id FROM documents)", "vec_id IN (SELECT item_id FROM benchmark)")},
    lists AS (SELECT query_id, 0 AS list_idx, rank, chunk_id FROM dense UNION ALL SELECT query_id, 1, rank, chunk_id FROM bm25),
    fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_idx * 1000000 + rank) AS first FROM lists GROUP BY ALL)
    SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fused) WHERE rank <= {final}"""


@query(hybrid_sql(50, 10))
def rrf_hybrid(spark, d):
    a, b = hybrid_parts(spark, d, 50)
    return retrieval.rrf(retrieval.as_list(a, 0).unionByName(retrieval.as_list(b, 1)), 60, 10).select("query_id", "chunk_id", "score", "rank")


@query(hybrid_sql(10, 5))
def candidate_limit(spark, d):
    a, b = hybrid_parts(spark, d, 10)
    return retrieval.rrf(retrieval.as_list(a, 0).unionByName(retrieval.as_list(b, 1)), 60, 5).select("query_id", "chunk_id", "score", "rank")


VARIANTS_SQL = """base AS (SELECT item_id, text, string_split(text, '. ') AS parts FROM benchmark),
    v AS (SELECT item_id, 0 AS variant_idx, trim(text, ' ') AS text, 1.0::DOUBLE AS weight FROM base UNION ALL SELECT item_id, 1, trim(parts[-1], ' '), 1.0 FROM base
        UNION ALL SELECT item_id, i + 1, trim(parts[i], ' '), 1.0::DOUBLE / least(len(parts), 4) FROM base, range(1, 5) r(i) WHERE i <= len(parts)),
    variants AS (SELECT item_id, variant_idx, text, weight FROM v WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY variant_idx) = 1)"""


def rewrites(spark, d) -> DataFrame:
    """A stand-in for a model's rewrites: the last sentence restates a question, its sentences are the sub-issues."""
    parts = F.split("text", r"\. ")
    return questions(spark, d).select("query_id", F.element_at(parts, -1).alias("statutory_query"), parts.alias("sub_issues"))


@query(f"WITH {VARIANTS_SQL} SELECT item_id AS query_id, variant_idx::INTEGER AS variant_idx, text, round(weight, 9) AS weight FROM variants")
def query_variants(spark, d):
    v = retrieval.variants(questions(spark, d), rewrites(spark, d), "fuse_decompose")
    return v.select("query_id", "variant_idx", "text", F.round("weight", 9).alias("weight"))


@query(f"""WITH {VARIANTS_SQL}, {bm25_sql(20, asked="SELECT item_id || '#' || variant_idx AS query_id, text FROM variants")},
    fused AS (SELECT item_id, chunk_id, round(sum(weight / (60 + rank)), 9) AS score, min(variant_idx * 1000000 + rank) AS first FROM bm25 JOIN variants ON query_id = item_id || '#' || variant_idx GROUP BY ALL)
    SELECT item_id AS query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM fused) WHERE rank <= 10""")
def rrf_weighted_multi_query(spark, d):
    v = retrieval.variants(questions(spark, d), rewrites(spark, d), "fuse_decompose")
    named = v.select(F.concat_ws("#", "query_id", "variant_idx").alias("q"), "query_id", "variant_idx", "weight", "text")
    each = retrieval.bm25(corpus(spark, d), named.select(F.col("q").alias("query_id"), "text"), 20).withColumnRenamed("query_id", "q")
    lists = each.join(named.drop("text"), "q").select("query_id", F.col("variant_idx").alias("list_idx"), "rank", "chunk_id", "weight")
    return retrieval.rrf(lists, 60, 10).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {bm25_sql(10)}, joined AS (SELECT b.*, list_distinct({TOK.replace('text', 'q.text')}) AS qt, list_distinct({TOK.replace('text', 'd.text')}) AS dt FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id),
    s AS (SELECT *, CASE WHEN rank <= 5 THEN round(len(list_intersect(qt, dt)) / greatest(len(qt), 1), 6) END AS new_score FROM joined)
    SELECT query_id, chunk_id, coalesce(new_score, score) AS score, rank::INTEGER AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY (new_score IS NOT NULL) DESC, new_score DESC, rank)::INTEGER AS rank FROM s""")
def rerank_head(spark, d):
    docs, q = corpus(spark, d), questions(spark, d)
    ranked = retrieval.bm25(docs, q, 10).select("query_id", "chunk_id", "score", "rank")
    pairs = ranked.join(q.withColumnRenamed("text", "q"), "query_id").join(docs.select("chunk_id", "text"), "chunk_id")
    return retrieval.rerank_head(ranked, pairs.select("query_id", "chunk_id", retrieval.lexical_overlap(F.col("q"), F.col("text")).alias("new_score")), 5)


# -- evaluation ---------------------------------------------------------------------------------------------------

SENTENCES = "SELECT DISTINCT {id}, trim(s, ' ') AS s FROM (SELECT {id}, unnest(string_split(text, '.')) AS s FROM {t}) WHERE length(trim(s, ' ')) >= 30"
GOLD_SQL = f"gold AS (SELECT DISTINCT item_id AS query_id, doc_id AS chunk_id FROM ({SENTENCES.format(id='item_id', t='benchmark')}) JOIN ({SENTENCES.format(id='doc_id', t='documents')}) USING (s))"
CATEGORY_SQL = "CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 300 THEN 'middle' ELSE 'long' END"


def sentences(rows: DataFrame, id_col: str) -> DataFrame:
    each = rows.select(F.col(id_col), F.explode(F.split("text", r"\.")).alias("s")).select(id_col, F.trim("s").alias("s"))
    return each.where(F.length("s") >= 30).distinct()


def gold(spark, d) -> DataFrame:
    """Documents that hold a sentence of a question's passage: an equality join on sentences."""
    asked = sentences(questions(spark, d), "query_id")
    return asked.join(sentences(corpus(spark, d).select("chunk_id", "text"), "chunk_id"), "s").select("query_id", "chunk_id").distinct()


def category():
    return F.when(F.length("text") < 200, "short").when(F.length("text") < 300, "middle").otherwise("long")


def metrics_sql(p: str = "") -> str:
    ks = ", ".join(f"round(count_if(rank <= {k}) / count(*), 9) AS recall_{k}, CASE WHEN count_if(rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}" for k in (1, 3, 5))
    return f"{p}metrics AS (SELECT query_id, count(*) AS n_gold, {ks}, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS mrr, min(rank)::INTEGER AS first_gold_rank FROM gold LEFT JOIN {p}bm25 USING (query_id, chunk_id) GROUP BY query_id)"


@query(f"WITH {bm25_sql(10)}, {GOLD_SQL}, {metrics_sql()} SELECT * FROM metrics")
def retrieval_metrics_by_item(spark, d):
    return evaluation.retrieval_metrics(retrieval.bm25(corpus(spark, d), questions(spark, d), 10), gold(spark, d))


@query(f"""WITH {bm25_sql(10)}, {GOLD_SQL}, {metrics_sql()}, items AS (SELECT m.*, {CATEGORY_SQL} AS category FROM metrics m JOIN benchmark ON item_id = query_id),
    g AS (SELECT category, grouping(category) AS overall, count(*) AS n, count(recall_5) AS n_recall_5, count(mrr) AS n_mrr, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr FROM items GROUP BY GROUPING SETS ((category), ())),
    c AS (SELECT unnest(['short', 'middle', 'long', 'none']) AS category, 0 AS overall UNION ALL SELECT NULL, 1)
    SELECT c.category, c.overall::INTEGER AS overall, coalesce(n, 0) AS n, coalesce(n_recall_5, 0) AS n_recall_5, coalesce(n_mrr, 0) AS n_mrr, recall_5, mrr FROM c LEFT JOIN g ON g.overall = c.overall AND g.category IS NOT DISTINCT FROM c.category""")
def metrics_by_category_with_overall(spark, d):
    q = questions(spark, d)
    m = evaluation.retrieval_metrics(retrieval.bm25(corpus(spark, d), q, 10), gold(spark, d)).join(q.select("query_id", category().alias("category")), "query_id")
    names = spark.createDataFrame([("short",), ("middle",), ("long",), ("none",)], "category string")
    return evaluation.by_category(m, ["recall_5", "mrr"], names)


@query(f"""WITH {bm25_sql(10)}, {bm25_sql(10, b=0.0, p='flat_')}, {GOLD_SQL}, {metrics_sql()}, {metrics_sql('flat_')},
    each AS (SELECT 'bm25' AS variant, * FROM metrics UNION ALL SELECT 'bm25_flat', * FROM flat_metrics), items AS (SELECT e.*, {CATEGORY_SQL} AS category FROM each e JOIN benchmark ON item_id = query_id)
    SELECT variant, category, grouping(category)::INTEGER AS overall, count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(hit_5), 6) AS hit_5, round(avg(mrr), 6) AS mrr
    FROM items GROUP BY GROUPING SETS ((variant, category), (variant))""")
def ablation_grid(spark, d):
    docs, q = corpus(spark, d), questions(spark, d)
    grid = {"bm25": 0.75, "bm25_flat": 0.0}
    runs = None
    for name, b in grid.items():
        one = retrieval.bm25(docs, q, 10, b=b).select(F.lit(name).alias("variant"), "query_id", "chunk_id", "rank")
        runs = one if runs is None else runs.unionByName(one)
    return evaluation.ablation(runs, gold(spark, d), q.select("query_id", category().alias("category"))).withColumn("overall", F.col("overall").cast("int"))


@query(f"WITH {GOLD_SQL} SELECT doc_id AS chunk_id, lang FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM gold)")
def uncovered_docs(spark, d):
    return evaluation.uncovered(corpus(spark, d), gold(spark, d)).select("chunk_id", F.col("doc_type").alias("lang"))


@query(f"WITH {GOLD_SQL} SELECT lang, count(*) AS total, count(g) AS covered, count(*) - count(g) AS uncovered FROM documents LEFT JOIN (SELECT DISTINCT chunk_id AS g FROM gold) ON g = doc_id GROUP BY lang")
def coverage_groups(spark, d):
    return evaluation.coverage(corpus(spark, d).withColumnRenamed("doc_type", "lang"), gold(spark, d), "lang")


def judged_items(spark, d) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as judged answers: low quality is a failed call, toxic text a refusal."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    items = rows.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("category"), (F.col("toxic") == 1).alias("refused"), F.when(F.col("doc_id") % 50 == 7, "timeout").alias("error"))
    metric = F.explode(F.array(*map(F.lit, ("faithfulness", "relevance", "refusal", "injection")))).alias("metric")
    judged = rows.select(F.col("doc_id").alias("item_id"), "quality", metric).select(
        "item_id", "metric", F.when(F.col("metric").isin("refusal", "injection"), F.col("item_id") % 2).otherwise(1 + F.col("item_id") % 5).cast("double").alias("value"), (F.col("quality") == 0).alias("failed"))
    return items, judged


JUDGED_SQL = """items AS (SELECT doc_id, lang AS category, toxic = 1 AS refused, CASE WHEN doc_id % 50 = 7 THEN 'timeout' END AS error, quality FROM labels JOIN documents USING (doc_id)),
    judged AS (SELECT *, CASE WHEN quality = 1 THEN (1 + doc_id % 5)::DOUBLE END AS s, CASE WHEN quality = 1 THEN (doc_id % 2)::DOUBLE END AS v FROM items),
    scores AS (SELECT category, count(*) AS n, count(error) AS errors, round(avg(s), 6) AS faithfulness_mean, round(avg(CASE WHEN s >= 4 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END::DOUBLE), 6) AS faithfulness_pass_rate, count(s) AS faithfulness_n,
        round(avg(s), 6) AS relevance_mean, round(avg(CASE WHEN s >= 4 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END::DOUBLE), 6) AS relevance_pass_rate, count(s) AS relevance_n, round(avg(v), 6) AS refusal_correctness, count(v) AS refusal_n,
        round(avg(v), 6) AS injection_resisted, count(v) AS injection_n, (4 * count_if(quality = 0))::BIGINT AS judge_failed, round(avg(CASE WHEN error IS NULL THEN refused::INT END), 6) AS refusal_rate FROM judged GROUP BY category)"""


@query(f"WITH {JUDGED_SQL} SELECT * FROM scores")
def judge_aggregate(spark, d):
    return evaluation.answer_scores(*judged_items(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT category, CASE WHEN faithfulness_n > 0 THEN NULL WHEN n = 0 THEN 'no items' WHEN errors = n THEN 'every item failed' WHEN judge_failed > 0 THEN 'the judge failed' ELSE 'does not apply' END AS reason FROM scores")
def empty_cell_reasons(spark, d):
    return evaluation.missing_reason(evaluation.answer_scores(*judged_items(spark, d)))


@query(f"""WITH {JUDGED_SQL}, a AS (SELECT (4 * count_if(quality = 1))::BIGINT AS scored, (4 * count_if(quality = 0))::BIGINT AS failed, count(error) AS unjudged, count(*) AS n FROM judged)
    SELECT scored, failed, unjudged, CASE WHEN n > 0 AND scored = 0 THEN 'unavailable' WHEN failed > 0 OR unjudged > 0 THEN 'degraded' ELSE 'ok' END AS status FROM a""")
def judge_status(spark, d):
    return evaluation.judge_status(*judged_items(spark, d))


@query("""SELECT item_id, metric FROM (SELECT item_id, unnest(list_filter([CASE WHEN true THEN 'refusal' END, CASE WHEN c = 'long' THEN 'injection' END, CASE WHEN item_id % 7 <> 0 THEN 'faithfulness' END, CASE WHEN item_id % 3 <> 0 THEN 'relevance' END], lambda x: x IS NOT NULL)) AS metric
    FROM (SELECT item_id, """ + CATEGORY_SQL + " AS c FROM benchmark))")
def wanted_judgements(spark, d):
    items = questions(spark, d).select(F.col("query_id").alias("item_id"), category().alias("category"), (F.col("query_id") % 3 != 0).alias("answerable"), (F.col("query_id") % 7 == 0).alias("canned"))
    return evaluation.wanted_metrics(items, ["long"])


# -- request log --------------------------------------------------------------------------------------------------

LOG_SQL = """log AS (SELECT event_id AS id, ts, 'c' || (user_id % 5) AS config_hash, value AS latency_ms, json_extract_string(props, '$.k')::BIGINT AS tokens_in, json_extract_string(props, '$.k')::BIGINT * 2 AS tokens_out,
    json_extract_string(props, '$.k')::BIGINT / 1000 AS cost_usd, (event_type = 'view')::INT AS cached, (event_type = 'error')::INT AS refused, CASE WHEN event_type IN ('signup', 'purchase') THEN 'eval' ELSE 'api' END AS source FROM events)"""
SUMMARY_SQL = "count(*) AS n, coalesce(sum(cached), 0)::BIGINT AS cached, coalesce(sum(refused), 0)::BIGINT AS refused, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.99) AS p99_ms, round(avg(cost_usd), 9) AS mean_cost, round(avg(refused), 9) AS refusal_rate"


def log(spark, d) -> DataFrame:
    return requests_of_events(table(spark, d, "events"))


@query(f"WITH {LOG_SQL} SELECT source, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, quantile_disc(latency_ms, 1.0) AS p100 FROM log GROUP BY source")
def latency_percentiles(spark, d):
    return requests.nearest_ranks(log(spark, d), "latency_ms", {f"p{p}": p for p in (50, 95, 99, 100)}, "source")


@query(f"WITH {LOG_SQL} SELECT config_hash, {SUMMARY_SQL} FROM log GROUP BY config_hash")
def request_summary(spark, d):
    return requests.summary(log(spark, d), "config_hash")


for _unit in ("hour", "day", "week"):

    def _by(spark, d, unit=_unit):
        return requests.over_time(log(spark, d), unit)

    _by.__name__ = f"requests_by_{_unit}"
    query(f"WITH {LOG_SQL} SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS bucket, {SUMMARY_SQL} FROM log GROUP BY 1")(_by)


@query(f"WITH {LOG_SQL} SELECT count(*) AS total, sum(cached)::BIGINT AS cached, sum(refused)::BIGINT AS refused, count_if(source = 'api')::BIGINT AS from_api, count_if(source = 'eval')::BIGINT AS from_eval FROM log")
def request_counts(spark, d):
    return requests.counts(log(spark, d))


@query(f"WITH {LOG_SQL} SELECT {SUMMARY_SQL} FROM log WHERE config_hash = 'c1' AND source = 'api' AND ts >= TIMESTAMP '2024-01-02' AND cached = 0")
def metrics_where(spark, d):
    return requests.summary(log(spark, d).where(requests.where("c1", "api", "2024-01-02", False)))


@query(f"""WITH {LOG_SQL}, p AS (SELECT *, tokens_in // 4 AS r, tokens_in // 5 AS w FROM log)
    SELECT id, round((tokens_in + w * 1.25 + r * 0.1) * (CASE WHEN tokens_in + r + w > 100 THEN 6.0 ELSE 3.0 END / 1e6) + tokens_out * (CASE WHEN tokens_in + r + w > 100 THEN 22.5 ELSE 15.0 END / 1e6), 9) AS cost FROM p""")
def cost_per_request(spark, d):
    p = measures.Pricing(3.0, 15.0, 100, 6.0, 22.5, 1.25, 0.1)
    cost = measures.cost_usd(F.col("tokens_in"), F.col("tokens_out"), F.expr("tokens_in div 4"), F.expr("tokens_in div 5"), p)
    return log(spark, d).select("id", F.round(cost, 9).alias("cost"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT config_hash AS run_id, round(avg(latency_ms), 6) AS mean_ms, round(avg(cost_usd), 9) AS mean_cost FROM log GROUP BY ALL)
    SELECT run_id, 'mean_ms' AS metric, mean_ms AS value FROM r UNION ALL SELECT run_id, 'mean_cost', mean_cost FROM r""")
def history_long(spark, d):
    runs = log(spark, d).groupBy(F.col("config_hash").alias("run_id")).agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(F.avg("cost_usd"), 9).alias("mean_cost"))
    return evaluation.history(runs, ["mean_ms", "mean_cost"])


@query(f"WITH {LOG_SQL} SELECT config_hash AS run_id, round(avg(latency_ms), 6) AS mean_ms, round(avg(cost_usd), 9) AS mean_cost FROM log GROUP BY ALL")
def history_pivot(spark, d):
    return evaluation.pivoted(history_long(spark, d), ["mean_ms", "mean_cost"])


@query(f"""WITH {LOG_SQL}, b AS (SELECT id, config_hash, cached, round(coalesce(sum(CASE WHEN cached = 0 THEN cost_usd ELSE 0 END) OVER (PARTITION BY config_hash ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM log)
    SELECT id, spent_before, cached = 1 OR spent_before < 20 AS allowed FROM b""")
def budget_cutoff(spark, d):
    calls = log(spark, d).select(F.col("config_hash").alias("run_id"), F.col("id").alias("ord"), "id", "cost_usd", "cached")
    return caches.within_budget(calls, 20.0).select("id", "spent_before", "allowed")


# -- spans --------------------------------------------------------------------------------------------------------


@query("""SELECT 'fixed:' || doc_id || ':' || i AS chunk_id, doc_id, i::INTEGER AS i, (i * 800)::INTEGER AS start, (i * 800 + length(substr(text, i * 800 + 1, 1000)))::INTEGER AS "end", md5(substr(text, i * 800 + 1, 1000)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 200, 1) - 1) // 800 + 1)) AS i FROM documents)""")
def fixed_windows(spark, d):
    w = spans.fixed_windows(table(spark, d, "documents"), 1000, 200)
    return w.select("chunk_id", "doc_id", "i", "start", "end", F.md5("text").alias("digest"))


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("ord"), "text")


SPANS_SQL = """spans AS (SELECT conv_id AS doc_id, conv_id || ':' || turn AS chunk_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(text) AS n FROM conversations)"""


@query(f'WITH {SPANS_SQL} SELECT doc_id, chunk_id, start, (start + n)::BIGINT AS "end" FROM spans')
def document_spans(spark, d):
    return spans.document_spans(turns(spark, d))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def document_texts(spark, d):
    return spans.document_texts(turns(spark, d)).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {SPANS_SQL}, texts AS (SELECT conv_id AS doc_id, length(string_agg(text, chr(10) ORDER BY turn)) AS len FROM conversations GROUP BY conv_id),
    w AS (SELECT doc_id, 'fixed:' || doc_id || ':' || i AS chunk_id, i * 400 AS s, least(i * 400 + 500, len) AS e FROM (SELECT *, unnest(range(0, (greatest(len - 100, 1) - 1) // 400 + 1)) AS i FROM texts)),
    o AS (SELECT w.chunk_id, g.chunk_id AS gold_id, greatest(0, least(e, start + n) - greatest(s, start)) AS shared, least(e - s, n) AS shorter FROM w JOIN spans g USING (doc_id))
    SELECT chunk_id, gold_id, shared::BIGINT AS shared FROM o WHERE shorter > 0 AND shared >= 0.5 * shorter""")
def span_covers(spark, d):
    windows = spans.fixed_windows(spans.document_texts(turns(spark, d)), 500, 100).select("doc_id", "chunk_id", "start", "end")
    return spans.covering(windows, spans.document_spans(turns(spark, d)), 0.5, 1000)


@query("""WITH v AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT e.event_id, v.seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_events(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return spans.as_of(left, right, "user_id", "ts", "ts", "seen").select("event_id", "seen")


@query("""SELECT key, value, ts FROM (SELECT 'u' || user_id || ':' || event_type AS key, event_id::VARCHAR AS value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id::VARCHAR DESC) AS r FROM events) WHERE r = 1""")
def kv_latest(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id", F.lit(":"), "event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "ts")
    return caches.upsert(e.where("value % 2 = 0"), e.where("value % 2 = 1"))


@query("""WITH c AS (SELECT md5(text) AS key, min(doc_id) AS value FROM documents WHERE lang = 'en' GROUP BY 1) SELECT doc_id, value, value IS NOT NULL AS hit FROM documents LEFT JOIN c ON key = md5(text)""")
def cache_probe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("key"))
    cache = rows.where("lang = 'en'").groupBy("key").agg(F.min("doc_id").alias("value"))
    return caches.probe(rows, cache).select("doc_id", "value", "hit")


@query("SELECT chunk_id, sum(n)::BIGINT AS n FROM (SELECT doc_id AS chunk_id, length(text) AS n FROM documents) GROUP BY 1")
def cache_fill(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text", F.md5("text").alias("key"))
    cache = rows.where("lang = 'en'").groupBy("key").agg(F.max(F.length("text")).alias("value"))
    out, _ = caches.filled(rows, cache, lambda missing: missing.withColumn("value", F.length("text")))
    return out.groupBy("chunk_id").agg(F.sum("value").alias("n"))


@query("""SELECT page_id, sum(length(t))::BIGINT AS n_chars, count(*) AS n_lines FROM (SELECT page_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|li|ul|h[1-6]|br|article|nav|footer|title|tr|table)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: x <> '')) AS t FROM pages) GROUP BY page_id""")
def html_lines(spark, d):
    from ..sources.readers import read_lines

    return read_lines(table(spark, d, "pages")).groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_lines"))
