"""Key-value tables: latest-wins upserts, batched lookups, and computing only what a cache lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_key(*parts: Column) -> Column:
    """sha256 over the parts as one JSON object; white space in text counts once."""
    named = [F.regexp_replace(p.cast("string"), r"(?U)\s+", " ").alias(f"p{i}") for i, p in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def latest(entries: DataFrame) -> DataFrame:
    """The last entry (ts, then value) of each key."""
    return entries.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("e")).select("key", "e.ts", "e.value")


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    return latest(table.select("key", "ts", "value").unionByName(new.select("key", "ts", "value")))


def get_many(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of every asked key; null where the table has none."""
    return keys.select("key").distinct().join(table.select("key", "value"), "key", "left")


def probe(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with `value` and `hit`."""
    return rows.join(table.select("key", "value").withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def filled(rows: DataFrame, table: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every row with its value, and the entries that were computed: compute sees each missing key once."""
    missing = rows.join(table.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = compute(missing).select("key", "value")
    return rows.join(table.select("key", "value").unionByName(fresh), "key", "left"), fresh


def storable(results: DataFrame) -> DataFrame:
    """Only calls that ended by themselves are kept; one cut short is tried again."""
    return results.where(F.col("stop_reason").isin("end_turn", "refusal"))


def within_budget(calls: DataFrame, cap: float) -> DataFrame:
    """Calls (run_id, ord, cost_usd, cached) with `allowed`: misses go on while what was spent before is under cap."""
    before = F.sum(F.when(F.col("cached") == 0, F.col("cost_usd")).otherwise(0.0)).over(Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return calls.withColumn("spent_before", F.round(F.coalesce(before, F.lit(0.0)), 6)).withColumn("allowed", (F.col("cached") == 1) | (F.col("spent_before") < cap))


def index_is_current(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: whether a vector table holds every chunk with its present text, of one vector size."""
    now = chunks.select("chunk_id", F.xxhash64("text").alias("now"))
    joined = now.join(vectors.select("chunk_id", F.col("text_hash").alias("then"), F.size("vector").alias("size")), "chunk_id", "full")
    return joined.agg((F.count_if(F.col("now").isNull() | F.col("then").isNull() | (F.col("now") != F.col("then"))) == 0).alias("same"), (F.countDistinct("size") <= 1).alias("one_size")).select((F.col("same") & F.col("one_size")).alias("current"))
