"""Text spans: where chunks lie in their documents, windows of fixed size, and what covers what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import overlap


def document_spans(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, start, end) of chunks joined by a line feed in order."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return chunks.select("doc_id", "chunk_id", start.cast("bigint").alias("start"), F.length("text").alias("n")).select("doc_id", "chunk_id", "start", (F.col("start") + F.col("n")).alias("end"))


def document_texts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY ord)").alias("text"))


def fixed_windows(docs: DataFrame, size: int, shared: int) -> DataFrame:
    """(chunk_id, doc_id, i, start, end, text): windows of `size` characters that share `shared` with the one before."""
    if not 0 <= shared < size:
        raise ValueError("need 0 <= shared < size")
    last = F.greatest(F.length("text") - shared, F.lit(1)) - 1
    each = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), last, F.lit(size - shared))).alias("i", "start"))
    piece = F.substring(F.col("text"), F.col("start") + 1, F.lit(size))
    return each.select(F.concat(F.lit("fixed:"), "doc_id", F.lit(":"), "i").alias("chunk_id"), "doc_id", "i", "start", (F.col("start") + F.length(piece)).alias("end"), piece.alias("text"))


def covering(windows: DataFrame, gold: DataFrame, least: float, width: int) -> DataFrame:
    """(chunk_id, gold_id) where a window shares `least` of the shorter of the two with a gold span.

    Both (doc_id, start, end). Spans are put in bins of `width` characters, so that one long document's pairs are
    sought among neighbours only; a pair is taken in the first bin that both touch.
    """
    bins = lambda start, end: F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))
    w = windows.select("doc_id", "chunk_id", "start", "end", F.explode(bins("start", "end")).alias("bin"))
    g = gold.select("doc_id", F.col("chunk_id").alias("gold_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    g = g.withColumn("bin", F.explode(bins("g_start", "g_end")))
    shared = overlap(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))
    shorter = F.least(F.col("end") - F.col("start"), F.col("g_end") - F.col("g_start"))
    first = F.col("bin") == F.floor(F.greatest("start", "g_start") / width)
    return w.join(g, ["doc_id", "bin"]).where(first & (shorter > 0) & (shared >= F.lit(least) * shorter)).select("chunk_id", "gold_id", shared.alias("shared"))


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it.

    One sort by key and time; of right rows at one time the largest value holds. No pairs are made.
    """
    l = left.select(*[F.col(c) for c in left.columns], F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.groupBy(by, right_at).agg(F.max(value).alias("__v")).select(by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), "__v")
    w = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__at", "__side", "__v")


def located(spans: Column, pos: Column, field: str) -> Column:
    """The field of the last of ordered spans that starts at or before pos; null before the first."""
    return F.try_element_at(F.filter(spans, lambda s: s["offset"] <= pos), F.lit(-1))[field]
