"""Summaries of a request log (id, timestamp, config_hash, latency_ms, tokens, cost_usd, cached, refused, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def where(config_hash: str | list[str] | None = None, source: str | None = None, since: str | None = None, include_cached: bool = True) -> Column:
    out = F.lit(True)
    if config_hash:
        out = out & F.col("config_hash").isin([config_hash] if isinstance(config_hash, str) else list(config_hash))
    if source and source != "all":
        out = out & (F.col("source") == source)
    if since:
        out = out & (F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    return out if include_cached else out & (F.col("cached") == 0)


def percentile(column: str, p: float) -> Column:
    """Nearest rank: the smallest value that p per cent of the values do not exceed; null of nothing. It keeps a group's
    values in memory: for small groups, else see nearest_ranks."""
    if not 0 < p <= 100:
        raise ValueError("p must be above 0 and at most 100")
    return F.expr(f"percentile_disc({p / 100}D) WITHIN GROUP (ORDER BY {column})")


def nearest_ranks(log: DataFrame, column: str, ps: dict[str, float], *by: str) -> DataFrame:
    """Nearest-rank percentiles of each group: by, and a column for each name of ps.

    Equal values are counted before anything is sorted, and the counts are dealt by range: a group of any size is ranked
    in as many tasks as its values take, by what stands before each range, and no group is held in memory.
    """
    if not all(0 < p <= 100 for p in ps.values()):
        raise ValueError("p must be above 0 and at most 100")
    keys = [f"__k{i}" for i in range(len(by))]
    counts = log.where(F.col(column).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranges = cut(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    parts = ranges.groupBy(*keys, "__part").agg(F.sum("__n").alias("__m"))  # a row a group and range
    parts = parts.select(*(F.col(k).alias(f"{k}p") for k in keys), F.col("__part").alias("__p"), (F.sum("__m").over(group.orderBy("__part")) - F.col("__m")).alias("__before"), F.sum("__m").over(group).alias("__all"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}p"))
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    ranked = ranges.join(parts, same).withColumn("__upto", upto)
    picked = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__all") * F.lit(p) / 100 - F.lit(1e-9)), F.col("__v"))).alias(name) for name, p in ps.items()]
    return ranked.groupBy(*(F.col(k).alias(c) for c, k in zip(by, keys))).agg(*picked)


def summary(log: DataFrame, *by: str) -> DataFrame:
    sums = log.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("cached"), F.lit(0)).alias("cached"),
        F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"),
        F.round(F.avg("cost_usd"), 9).alias("mean_cost"),
        F.round(F.avg("refused"), 9).alias("refusal_rate"),
    )
    ranks = nearest_ranks(log, "latency_ms", {"p50_ms": 50, "p99_ms": 99}, *by).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = sums.join(ranks, same, "left")
    return out.select(*by, "n", "cached", "refused", "p50_ms", "p99_ms", "mean_cost", "refusal_rate")


def counts(log: DataFrame) -> DataFrame:
    """One row of totals, with a column for each source."""
    return log.agg(F.count("*").alias("total"), F.coalesce(F.sum("cached"), F.lit(0)).alias("cached"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"), *(F.count_if(F.col("source") == s).alias(f"from_{s}") for s in ("api", "eval")))


def over_time(log: DataFrame, unit: str) -> DataFrame:
    """Non-empty buckets of an hour, day or week (from Monday), in UTC."""
    if unit not in ("hour", "day", "week"):
        raise ValueError(unit)
    return summary(log.withColumn("bucket", F.date_trunc(unit, F.col("timestamp")).cast("timestamp_ntz")), "bucket")


def checked(log: DataFrame) -> DataFrame:
    """The rows to append; a row that breaks a constraint raises when it is written."""
    ok = F.expr("cached in (0, 1) and refused in (0, 1) and source in ('api', 'eval') and timestamp is not null and config_hash is not null and latency_ms is not null and cost_usd is not null")
    return log.withColumn("latency_ms", F.when(F.coalesce(ok, F.lit(False)), F.col("latency_ms")).otherwise(F.raise_error(F.lit("a request breaks a constraint")).cast("double")))

