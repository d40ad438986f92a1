"""Joins between chunks and the provisions that they are, cite, correct or commence with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL = r"^section (\d+[A-Z]?)(?:\(([a-z0-9]+)\))?(?:\(([a-z0-9]+)\))?$"


def label_parts(label: Column) -> list[Column]:
    """Section, sub-section and clause of "section 9(1)(a)"; null where absent."""
    return [F.when(F.regexp_extract(label, LABEL, i) != "", F.regexp_extract(label, LABEL, i)).alias(n) for i, n in ((1, "l_section"), (2, "l_sub"), (3, "l_clause"))]


def lookup(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that each label names: labels (label), chunks (chunk_id, ord, doc_type, section, sub_section, clause).

    A bare section gives all its chunks; with a sub-section those of it; with a clause that clause, or where no chunk
    is that clause the chunks of the sub-section that have none.
    """
    parts = labels.select("label", *label_parts(F.col("label"))).where("l_section is not null")
    act = chunks.where("doc_type = 'act'").select("chunk_id", "ord", "section", "sub_section", "clause")
    match = (F.col("section") == F.col("l_section")) & (F.col("l_sub").isNull() | (F.col("sub_section") == F.col("l_sub")))
    joined = parts.join(act, match)
    exact = F.coalesce(F.col("clause") == F.col("l_clause"), F.lit(False))
    any_exact = F.max(exact).over(Window.partitionBy("label"))
    return joined.withColumn("any_exact", any_exact).where(F.when(F.col("l_clause").isNull(), True).otherwise(exact | (~F.col("any_exact") & F.col("clause").isNull()))).select("label", "chunk_id", "ord")


def commencement(provisions: DataFrame, calendar: DataFrame, fallback: str | None) -> DataFrame:
    """The date of each (section, sub_section, clause): the calendar's most specific entry.

    calendar (section, sub_section, clause, in_force_date). Without a sub-section, the one date that all entries of
    the section share; else the fallback, as for a null section.
    """
    cal = calendar.select(F.col("section").alias("c1"), F.col("sub_section").alias("c2"), F.col("clause").alias("c3"), "in_force_date")
    at = lambda n, cond: cal.where(cond).select("c1", "c2", "c3", F.col("in_force_date").alias(n))
    same = cal.groupBy("c1").agg(F.countDistinct("in_force_date").alias("n"), F.min("in_force_date").alias("whole")).where("n = 1").select("c1", "whole")
    full = at("d3", F.lit(True))
    sub = at("d2", F.col("c3").isNull())
    one = at("d1", F.col("c2").isNull() & F.col("c3").isNull())
    out = (
        provisions.join(full, F.expr("section = c1 and sub_section <=> c2 and clause <=> c3"), "left").drop("c1", "c2", "c3")
        .join(sub, F.expr("section = c1 and sub_section <=> c2"), "left").drop("c1", "c2", "c3")
        .join(one, F.expr("section = c1"), "left").drop("c1", "c2", "c3")
        .join(same, F.expr("section = c1"), "left").drop("c1")
    )
    return out.withColumn("in_force_date", F.coalesce("d3", "d2", "d1", F.when(F.col("sub_section").isNull(), F.col("whole")), F.lit(fallback).cast("date"))).drop("d1", "d2", "d3", "whole")


def earliest_rule_date(rows: DataFrame, rule_dates: DataFrame) -> DataFrame:
    """The least commencement date over the rules that each row (chunk_id, see_rules) names."""
    each = rows.select("chunk_id", F.explode("see_rules").alias("rule"))
    return each.join(rule_dates, "rule", "left").groupBy("chunk_id").agg(F.min("in_force_date").alias("in_force_date"), F.count_if(F.col("in_force_date").isNull()).alias("n_missing"))


def attach_penalties(chunks: DataFrame, penalties: DataFrame) -> DataFrame:
    """Chunks with the penalty that cites them: penalties (row_ord, ref_ord, section, sub_section, penalty).

    A citation without a sub-section covers all of the section; of several the last row's last citation holds.
    """
    p = penalties.select(F.col("section").alias("p1"), F.col("sub_section").alias("p2"), F.col("penalty").alias("p_text"), F.struct("row_ord", "ref_ord").alias("at"))
    hit = chunks.select("chunk_id", "section", "sub_section").join(p, F.expr("section = p1 and (p2 is null or sub_section <=> p2)"))
    last = hit.groupBy("chunk_id").agg(F.max_by("p_text", "at").alias("attached"))
    return chunks.join(last, "chunk_id", "left").withColumn("penalty", F.coalesce("attached", "penalty")).drop("attached")


def expand(results: DataFrame, refs: DataFrame, chunks: DataFrame, max_per_chunk: int = 4, factor: float = 0.5, as_of: str | None = None) -> DataFrame:
    """One-hop cross-references: results (query_id, chunk_id, rank, score) with the chunks that they cite after them.

    refs (chunk_id, pos, label). Parents in order of rank take their cited chunks in order, most specific label first,
    at most max_per_chunk each, none that is there already or not in force. A chunk that one parent had no room for
    is left to the next, so each query's few candidates are folded in order, as an array.
    """
    depth = F.size(F.regexp_extract_all("label", F.lit(r"\("), F.lit(0)))
    cited = results.join(refs, "chunk_id").select("query_id", F.col("chunk_id").alias("parent"), F.col("rank").alias("p_rank"), F.col("score").alias("p_score"), "pos", depth.alias("depth"), "label")
    found = cited.join(lookup(refs.select("label").distinct(), chunks), "label")
    if as_of:
        found = found.join(chunks.where(F.col("in_force_date") <= F.lit(as_of).cast("date")).select("chunk_id"), "chunk_id", "left_semi")
    order = F.struct("p_rank", (-F.col("depth")).alias("broad"), "pos", "ord", "chunk_id", "parent", "p_score")
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("found"))
    base = results.groupBy("query_id").agg(F.collect_set("chunk_id").alias("seen"), F.count("*").cast("int").alias("n"))
    kind = "struct<parent:int,room:int,seen:array<string>,out:array<struct<chunk_id:string,rank:int,score:double,expanded_from:string>>>"

    def step(acc: Column, r: Column) -> Column:
        room = F.when(acc["parent"] == r["p_rank"], acc["room"]).otherwise(max_per_chunk)
        take = (room > 0) & ~F.array_contains(acc["seen"], r["chunk_id"])
        hit = F.struct(r["chunk_id"].alias("chunk_id"), (F.col("n") + F.size(acc["out"]) + 1).alias("rank"), (r["p_score"] * factor).alias("score"), r["parent"].alias("expanded_from"))
        return F.struct(
            r["p_rank"].alias("parent"),
            (room - take.cast("int")).alias("room"),
            F.when(take, F.concat(acc["seen"], F.array(r["chunk_id"]))).otherwise(acc["seen"]).alias("seen"),
            F.when(take, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        ).cast(kind)

    begin = F.struct(F.lit(-1).alias("parent"), F.lit(0).alias("room"), F.col("seen"), F.array().alias("out")).cast(kind)
    more = base.join(found, "query_id").select("query_id", F.explode(F.aggregate("found", begin, step)["out"]).alias("h")).select("query_id", "h.*")
    own = results.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("expanded_from"))
    return own.unionByName(more)
