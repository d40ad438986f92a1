"""Calls of a language model as a table: cache, budget, answers, judgements and rewrites around any batch function.

A model is a function from a list of requests (dictionaries with system, user, schema) to as many responses
(dictionaries with text, stop_reason and token counts). It runs in Python workers, a batch at a time; what is not
repeated from the cache is called once for each different request.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import Pricing, cost_usd
from ..sources.scratch import cut
from . import caches

Model = Callable[[list[dict]], list[dict]]
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
RESPONSE = "text string, stop_reason string, " + ", ".join(f"{t} bigint" for t in TOKENS)
#: Metrics that are right or wrong; the others are scores of 1 to 5.
VERDICTS = ("refusal", "injection")


class OverBudget(RuntimeError):
    """The money is spent; calls made so far are in the cache."""


class JudgeUnavailable(RuntimeError):
    """The judge cannot be asked at all."""


def call_key(name: str, params: str) -> Column:
    """Over the model, every parameter of the request, both prompts and the schema: any change is a miss."""
    return caches.request_key(F.lit(name), F.lit(params), F.col("system"), F.col("user"), F.col("schema"))


def generated(calls: DataFrame, model: Model) -> DataFrame:
    """Calls (key, system, user, schema) with the model's responses."""

    def run(batches):
        for pdf in batches:
            said = model(pdf[["system", "user", "schema"]].to_dict("records"))
            if len(said) != len(pdf):
                raise ValueError(f"the model gave {len(said)} responses to {len(pdf)} requests")
            rows = [(r.get("text"), r.get("stop_reason", "end_turn"), *(int(r.get(t, 0)) for t in TOKENS)) for r in said]
            yield pd.DataFrame(rows, columns=["text", "stop_reason", *TOKENS]).assign(key=pdf.key.values)[["key", "text", "stop_reason", *TOKENS]]

    return calls.select("key", "system", "user", "schema").mapInPandas(run, f"key string, {RESPONSE}")


def cached_calls(calls: DataFrame, cache: DataFrame, model: Model, name: str, params: str = "{}", prices: Pricing | None = None, cap: float | None = None, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(calls with responses and `cached`, entries to add to the cache).

    cache: (key, text, stop_reason, tokens). Misses are called once each, in blocks of about `block` by key; before each
    block what was spent is held against cap, and OverBudget is raised at or above it. Only answers that ended by
    themselves are cached.
    """
    keyed = cut(calls.withColumn("key", call_key(name, params)))
    known = cache.select("key", "text", "stop_reason", *TOKENS)
    missing = keyed.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    blocks = 1 if cap is None else 1 + missing.count() // block
    spent, fresh = 0.0, None
    for k in range(blocks):
        if cap is not None and spent >= cap:
            raise OverBudget(f"{spent:.2f} of {cap:.2f} spent")
        some = missing if blocks == 1 else missing.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)
        made = cut(generated(some, model))
        if prices:
            spent += made.agg(F.sum(cost_usd(*(F.col(t) for t in TOKENS), prices))).first()[0] or 0.0
        fresh = made if fresh is None else fresh.unionByName(made)
    both = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return keyed.join(both, "key"), caches.storable(fresh)


def answered(calls: DataFrame, supplied: DataFrame) -> DataFrame:
    """(answer_id, state, answer, citations, refused, refusal_reason) of responses (answer_id, text, stop_reason).

    supplied: (answer_id, chunk_id). Without a supplied chunk an answer is refused whatever was said; a model's own
    refusal and one without a citation that holds are refusals; what is cut short or is no answer of the schema is an error.
    """
    form = "answer string, refused boolean, refusal_reason string, citations array<string>"
    a = F.from_json("text", form, {"mode": "PERMISSIVE"})
    given = supplied.groupBy("answer_id").agg(F.collect_set("chunk_id").alias("chunks"))
    none = F.array().cast("array<string>")
    rows = calls.select("answer_id", "stop_reason", a.alias("a")).join(given, "answer_id", "left")
    kept = F.array_distinct(F.filter(F.coalesce("a.citations", none), lambda c: F.array_contains(F.col("chunks"), c)))
    usable = F.col("a.answer").isNotNull() & F.col("a.refused").isNotNull()
    reason = (
        F.when(F.col("chunks").isNull(), "insufficient_context")
        .when(F.col("stop_reason") == "refusal", "model_refusal")
        .when((F.col("stop_reason") == "end_turn") & usable & F.col("a.refused"), F.coalesce("a.refusal_reason", F.lit("model_refusal")))
        .when((F.col("stop_reason") == "end_turn") & usable & (F.size(kept) == 0), "insufficient_context")
    )
    state = F.when(reason.isNotNull(), "refused").when(F.col("stop_reason") == "max_tokens", "truncated").when((F.col("stop_reason") != "end_turn") | ~usable, "invalid").otherwise("answered")
    return rows.select("answer_id", state.alias("state"), F.when(state == "answered", F.col("a.answer")).alias("answer"), F.when(state == "answered", kept).otherwise(none).alias("citations"), (state == "refused").alias("refused"), reason.alias("refusal_reason"))


def judged(calls: DataFrame) -> DataFrame:
    """(item_id, metric, value, reasoning, failed) of responses (item_id, metric, text, stop_reason).

    A verdict is 1 or 0, a score must lie in 1 to 5; anything else, and a call that did not end by itself, has failed.
    """
    f = F.from_json("text", "reasoning string, score int, correct boolean")
    verdict = F.col("metric").isin(*VERDICTS)
    value = F.when(verdict, F.col("f.correct").cast("int").cast("double")).when(F.col("f.score").between(1, 5), F.col("f.score").cast("double"))
    value = F.when((F.col("stop_reason") == "end_turn") & F.col("f.reasoning").isNotNull(), value)
    rows = calls.select("item_id", "metric", "stop_reason", f.alias("f"))
    return rows.select("item_id", "metric", value.alias("value"), F.col("f.reasoning").alias("reasoning"), value.isNull().alias("failed"))


def preflight(calls: DataFrame, model: Model) -> None:
    """One real judgement before a run: raises JudgeUnavailable where it fails."""
    one = calls.limit(1).withColumn("key", F.lit("preflight"))
    said = one.select("key", "item_id", "metric").join(generated(one, model), "key")
    bad = judged(said).where("failed").count()
    if bad or one.isEmpty():
        raise JudgeUnavailable("the judge's first answer is no judgement")


def rewritten(calls: DataFrame, max_sub_issues: int = 4, fallback: bool = True) -> DataFrame:
    """(query_id, statutory_query, sub_issues, fell_back) of responses (query_id, text, stop_reason).

    A rewrite that failed leaves the question as it is and is marked; without fallback it raises when read.
    """
    f = F.from_json("text", "statutory_query string, sub_issues array<string>")
    good = F.coalesce((F.col("stop_reason") == "end_turn") & f["statutory_query"].isNotNull() & f["sub_issues"].isNotNull(), F.lit(False))
    if not fallback:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("query rewrite failed: "), F.col("query_id").cast("string"))).cast("boolean"))
    none = F.array().cast("array<string>")
    return calls.select("query_id", F.when(good, f["statutory_query"]).alias("statutory_query"), F.when(good, F.slice(f["sub_issues"], 1, max_sub_issues)).otherwise(none).alias("sub_issues"), (~good).alias("fell_back"))
