"""From lines of printed documents to the chunk table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rule_numbers
from ..operators import provisions, segments
from ..operators.provisions import earliest_rule_date
from ..sources.readers import union_corpora
from ..sources.scratch import cut


def numbered_chunks(lines: DataFrame, doc_type: str, calendar: DataFrame | None = None, fallback: str | None = None, max_chars: int = 3000, stop: str | None = None) -> DataFrame:
    """Chunks of an act or of rules with references and commencement dates.

    act: section, sub_section and clause are dated by the calendar's most specific entry. rules: by rule number.
    """
    act = doc_type == "act"
    cut = segments.segment_numbered(lines, max_chars, stop)
    number = F.when(F.col("number") > 0, F.col("number").cast("string"))
    sub = F.when(F.col("sub") > 0, F.col("sub").cast("string"))
    name = F.concat(
        F.lit("act:s" if act else "rules:r"), F.coalesce(number, F.lit("0")), F.coalesce(F.concat(F.lit("("), sub, F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit("("), "clause", F.lit(")")), F.lit("")), F.when(F.col("kind") == "illustration", ":ill").otherwise(""),
    )
    rows = cut.select(
        "doc_id", F.col("seq").cast("bigint").alias("ord"), name.alias("chunk_id"), F.lit(doc_type).alias("doc_type"), F.nullif("title", F.lit("")).alias("title"), "chapter", "lead_in", "text",
        (F.col("kind") == "illustration").alias("illustration"), number.alias("section" if act else "rule"), sub.alias("sub_section" if act else "sub_rule"), "clause", *(c for c in ("spans",) if c in cut.columns),
    )
    refs = segments.reference_labels(segments.extract_refs(rows.select(F.col("chunk_id").alias("id"), "text"))).withColumnRenamed("id", "chunk_id")
    none = F.array().cast("array<string>")
    rows = rows.join(refs, "chunk_id", "left").withColumns({c: F.coalesce(c, none) for c in ("refers_to", "refers_to_provisions")})
    if calendar is None:
        return rows.withColumn("in_force_date", F.lit(fallback).cast("date"))
    if act:
        return provisions.commencement(rows, calendar, fallback)
    return rows.join(calendar, "rule", "left").withColumn("in_force_date", F.coalesce("in_force_date", F.lit(fallback).cast("date")))


def with_penalties(chunks: DataFrame, schedule: DataFrame) -> DataFrame:
    """Act chunks with the penalty of the schedule rows (ord, text "breach Penalty: amount") that cite them."""
    split = F.split("text", r" Penalty: ", 2)
    rows = schedule.select(F.col("ord").alias("id"), split[0].alias("text"), split[1].alias("penalty"))
    refs = segments.extract_refs(rows).join(rows.select("id", "penalty"), "id")
    penalties = refs.select(F.col("id").alias("row_ord"), F.col("pos").alias("ref_ord"), "section", "sub_section", "penalty")
    return provisions.attach_penalties(chunks.withColumn("penalty", F.lit(None).cast("string")), penalties)


@dataclass(frozen=True)
class Ingested:
    """chunks in the order of the corpus, corrections, (section, sub_section, clause, date) and (rule, date)."""

    chunks: DataFrame
    patches: DataFrame
    calendar: DataFrame
    rule_dates: DataFrame


def build(act: DataFrame, penalties: DataFrame, rules: DataFrame, notices: DataFrame, corrigenda: DataFrame, published: str, rules_published: str, enacted: str, max_section: int = 44, max_chars: int = 3000, schedules: DataFrame | None = None) -> Ingested:
    """The whole corpus from lines: notices date the act, its sections take the penalties of its schedule, corrections are
    made in the rules, and the rules' first rule dates them.

    act, rules, notices: lines (doc_id, ord, text; rules also page, line_no); penalties (ord, text); corrigenda (doc_id,
    text); schedules: entries of the rules as segment_schedules gives them. Repeated chunk ids raise.
    """
    paragraphs = segments.segment_paragraphs(notices)
    clauses = paragraphs.where(F.col("label").rlike("^[a-z]{1,2}$"))
    calendar = cut(segments.commencement_calendar(clauses.select(F.struct("doc_id", "seq").alias("id"), "text"), published, max_section))
    acts = with_penalties(numbered_chunks(act, "act", calendar, enacted, max_chars), penalties)
    patches = cut(corrigenda.select("doc_id", F.posexplode(segments.parse_patches(F.col("text"))).alias("seq", "p")).select(F.col("doc_id").alias("corrigendum"), "seq", "p.*"))
    plain = cut(numbered_chunks(rules, "rules", max_chars=max_chars))
    one = plain.where("rule = '1' and sub_rule is not null")
    rule_dates = cut(segments.rule_calendar(one.select(F.col("ord").alias("id"), "text"), rules_published))
    target = plain.select("doc_id").first()  # the rules are one document
    made = patches.withColumn("doc_id", F.lit(target.doc_id if target else None))
    mended = segments.apply_patches(plain.select("doc_id", "chunk_id", "ord", "text", "spans"), made.select("doc_id", "seq", "item", "page", "line", "line_end", "old_text", "new_text", "kind"))
    mended = mended.select("chunk_id", F.col("text").alias("text_corrected"), "text_original", "n_patches", F.col("error").alias("patch_error"))
    dated = plain.drop("in_force_date", "spans").join(mended, "chunk_id").join(rule_dates, "rule", "left")
    dated = dated.withColumn("in_force_date", F.coalesce("in_force_date", F.lit(rules_published).cast("date"))).withColumn("text", F.coalesce("text_corrected", "text")).drop("text_corrected")
    refs = segments.reference_labels(segments.extract_refs(dated.select(F.col("chunk_id").alias("id"), "text"), max_section)).withColumnRenamed("id", "chunk_id")
    dated = dated.drop("refers_to", "refers_to_provisions").join(refs, "chunk_id", "left")
    noted = paragraphs.select("doc_id", F.col("seq").cast("bigint").alias("ord"), F.concat(F.lit("notice:"), "doc_id", F.lit(":"), "label").alias("chunk_id"), F.lit("notification").alias("doc_type"), "text", F.when(F.col("label").rlike("^[a-z]{1,2}$"), F.col("label")).alias("clause"), F.lit(published).cast("date").alias("in_force_date"))
    corrected = patches.select(F.col("corrigendum").alias("doc_id"), F.col("seq").cast("bigint").alias("ord"), F.concat(F.lit("corrigendum:"), "corrigendum", F.lit(":"), "item").alias("chunk_id"), F.lit("corrigendum").alias("doc_type"), F.concat(F.lit("for "), "old_text", F.lit(", read "), "new_text").alias("text"))
    parts = [acts, dated]
    if schedules is not None:
        entry = F.concat(F.lit("rules:sch:"), F.concat_ws(":", "schedule", "part", "item"))
        seen = schedules.withColumn("see_rules", rule_numbers(F.concat(F.lit("rules "), F.regexp_replace(F.coalesce("see", F.lit("")), r"^rules?\s+", ""))))
        when = earliest_rule_date(seen.select(entry.alias("chunk_id"), "see_rules"), rule_dates).select("chunk_id", "in_force_date")
        parts.append(seen.select("doc_id", F.col("seq").cast("bigint").alias("ord"), entry.alias("chunk_id"), F.lit("rules").alias("doc_type"), "schedule", "part", "item", "text", "see_rules").join(when, "chunk_id", "left"))
    parts += [noted, corrected]
    every = None
    for i, x in enumerate(parts):
        x = x.withColumn("ord", F.lit(i) * (1 << 40) + F.col("ord"))  # one document after another
        every = x if every is None else every.unionByName(x, allowMissingColumns=True)
    return Ingested(union_corpora([cut(every)]), patches, calendar, rule_dates)
