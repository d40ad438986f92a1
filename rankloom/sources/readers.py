"""Readers and writers of the engine's tables. Schemas are given, never inferred; the corpus order is a column."""

from __future__ import annotations

import copy
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, blank lines skipped; missing lists are empty, a bad line or a repeated id raises.

    The order is the file's: `ord` as written, or where a line has none, its place among the lines.
    """
    with_ord = T.StructType([T.StructField("ord", T.LongType()), *schemas.CHUNK.fields])
    rows = spark.read.schema(with_ord).option("mode", "FAILFAST").json(path)
    lists = [f.name for f in schemas.CHUNK.fields if isinstance(f.dataType, T.ArrayType)]
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists} | {"illustration": F.coalesce("illustration", F.lit(False))})
    line = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # a block of bytes has fewer lines
    rows = rows.withColumn("ord", F.coalesce("ord", line))
    _raise_repeated(rows)
    return rows


def _raise_repeated(rows: DataFrame) -> None:
    twice = rows.groupBy("chunk_id").count().where("count > 1").select("chunk_id").take(5)
    if twice:
        raise ValueError(f"repeated chunk ids: {[r.chunk_id for r in twice]}")


def union_corpora(parts: list[DataFrame]) -> DataFrame:
    """All parts one after another; ids must be unique."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    _raise_repeated(out)
    return out


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The golden set, and (line, problem) of lines that are no JSON or have unknown fields."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    schema = T.StructType([*schemas.GOLDEN.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("g"), F.json_object_keys("value").alias("keys"))
    known = F.array(*(F.lit(f.name) for f in schemas.GOLDEN.fields))
    extra = F.array_except("keys", known)
    bad = parsed.where("g._corrupt_record is not null or keys is null").select(F.col("value").alias("line"), F.lit("not JSON of this form").alias("problem"))
    odd = parsed.where(F.size(extra) > 0).select(F.col("value").alias("line"), F.concat(F.lit("unknown fields "), F.array_join(extra, ", ")).alias("problem"))
    return parsed.where("g._corrupt_record is null").select("g.*").drop("_corrupt_record"), bad.unionByName(odd)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The request log; empty with its columns where there is none yet."""
    try:
        return spark.read.schema(schemas.REQUEST).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.REQUEST)


def read_eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, started_at, results): every readable results.json, by start."""
    rows = spark.read.option("wholetext", True).text(f"{folder}/*/results.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("results"))
    ok = rows.where(F.try_parse_json("results").isNotNull())
    return ok.select(F.element_at(F.split("path", "/"), -2).alias("run_id"), F.get_json_object("results", "$.started_at").alias("started_at"), "results").orderBy("started_at")


def read_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Lines of HTML pages without their markup: (doc_id, ord, text). Stands in for lines read from print."""
    no_script = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    broken = F.regexp_replace(no_script, r"(?i)</?(?:p|div|li|ul|h[1-6]|br|article|nav|footer|title|tr|table)\b[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", "")
    parts = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("ord"), "text")


def requests_of_events(events: DataFrame) -> DataFrame:
    """An event stream as a request log: an error is a refusal, a view came from the cache."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("config_hash"), F.col("value").alias("latency_ms"),
        k.alias("tokens_in"), (k * 2).alias("tokens_out"), (k / 1000).alias("cost_usd"),
        F.when(kind == "view", 1).otherwise(0).alias("cached"), F.when(kind == "error", 1).otherwise(0).alias("refused"),
        F.when(kind.isin("signup", "purchase"), "eval").otherwise("api").alias("source"),
    )


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    chunks.orderBy("ord").write.mode("overwrite").format(fmt).save(path)


def write_index(vectors: DataFrame, path: str, partition: str | None = None) -> None:
    """Vectors with their chunks' fields; a rerun replaces them."""
    w = vectors.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_json(path: str) -> dict | None:
    """A small JSON file on the driver; None where there is none."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def merged(*configs: dict) -> dict:
    """Configurations one over another: dictionaries merge, anything else replaces."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
