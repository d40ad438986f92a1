"""What is shown and checked of an answer: pinpoints, context documents, citations, mentions, and a stub model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import force_status, in_force
from ..functions.text import escaped, mentions

# What an entry of a schedule is called, and how document types are named.
ENTRY_LABELS = {
    "The Schedule": "row", "First Schedule": "item", "Second Schedule": "clause", "Third Schedule": "row", "Fourth Schedule": "row",
    "Fifth Schedule": "paragraph", "Sixth Schedule": "paragraph", "Seventh Schedule": "row",
}
DOC_LABELS = {
    "act": "Digital Personal Data Protection Act, 2023",
    "rules": "Digital Personal Data Protection Rules, 2025 (G.S.R. 846(E))",
    "notification": "Notification",
    "corrigendum": "Corrigendum G.S.R. 892(E)",
}


def _from(mapping: dict[str, str], key: Column, default: Column) -> Column:
    out = default
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def pinpoint() -> Column:
    """How a chunk is cited: "Section 9(1)", "Rule 8(3)", "Third Schedule, row 1"."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    paren = lambda c: F.when(has(c), F.concat(F.lit("("), F.col(c), F.lit(")"))).otherwise("")
    drawn = F.when(F.col("illustration"), ", Illustration").otherwise("")
    gsr = F.coalesce("gsr_no", F.lit("None"))
    item = F.regexp_replace("chunk_id", "^[^:]*:", "")
    label = _from(ENTRY_LABELS, F.col("schedule"), F.lit("item"))
    entry = F.when(label == "clause", F.concat(F.lit("("), F.col("item"), F.lit(")"))).otherwise(F.col("item"))
    schedule = F.concat(F.col("schedule"), F.when(has("part"), F.concat(F.lit(", Part "), F.col("part"))).otherwise(""))
    return (
        F.when(F.col("doc_type") == "corrigendum", F.when(item != "preamble", F.concat(gsr, F.lit(", item "), item)).otherwise(gsr))
        .when(F.col("doc_type") == "notification", F.concat(gsr, F.when(has("clause"), F.concat(F.lit(", clause ("), F.col("clause"), F.lit(")"))).otherwise("")))
        .when(has("schedule") & has("item") & F.col("item").startswith("Note"), F.concat(schedule, F.lit(", "), F.col("item")))
        .when(has("schedule"), F.concat(schedule, F.when(has("item"), F.concat(F.lit(", "), label, F.lit(" "), entry)).otherwise(""), drawn))
        .when(has("section"), F.concat(F.lit("Section "), F.col("section"), paren("sub_section"), paren("clause")))
        .when(has("rule"), F.concat(F.lit("Rule "), F.col("rule"), paren("sub_rule"), drawn))
        .when(F.col("doc_type") == "act", F.lit("Act, long title"))
        .when(F.col("doc_type") == "rules", F.lit("Rules, preamble"))
        .otherwise(F.col("chunk_id"))
    )


def rendered_chunk(index: Column, as_of: Column) -> Column:
    """A chunk as a numbered prompt document; its text and attributes are escaped."""
    by = F.col("corrected_by")
    fixed = by.isNotNull() & (by != "")
    attr = lambda name, v: F.concat(F.lit(f' {name}="'), escaped(v, True), F.lit('"'))
    head = F.concat(
        F.lit("<document"),
        attr("index", index.cast("string")),
        attr("chunk_id", F.col("chunk_id")),
        attr("pinpoint", pinpoint()),
        attr("source", _from(DOC_LABELS, F.col("doc_type"), F.col("doc_type"))),
        attr("in_force_date", F.coalesce(F.col("in_force_date").cast("string"), F.lit("unknown"))),
        attr("status", force_status(F.col("in_force_date"), as_of)),
        F.when(fixed, attr("corrected_by", by)).otherwise(""),
        F.lit(">\n"),
    )
    title = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.concat(F.lit("<title>"), escaped(F.col("title")), F.lit("</title>\n"))).otherwise("")
    note = F.when(fixed, F.concat(F.lit("<note>This text includes the corrections made by "), by, F.lit(".</note>\n"))).otherwise("")
    return F.concat(head, title, note, F.lit("<text>"), escaped(F.col("text")), F.lit("</text>\n</document>"))


def context(results: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """(query_id, context): each query's chunks by rank, blank lines between."""
    day = F.lit(as_of).cast("date")
    rows = results.select("query_id", "rank", "chunk_id").join(chunks, "chunk_id")
    docs = rows.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    docs = docs.select("query_id", F.struct("index", rendered_chunk(F.col("index"), day).alias("doc")).alias("d"))
    return docs.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["doc"]), "\n\n").alias("context"))


def citation_fields(as_of: str) -> list[Column]:
    return [F.col("chunk_id"), F.col("doc_type"), F.col("title"), pinpoint().alias("pinpoint"), F.col("in_force_date"), in_force(F.col("in_force_date"), F.lit(as_of).cast("date")).alias("in_force"), F.col("corrected_by")]


def valid_citations(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Answers (answer_id, refused, cited) with citations: those of chunks that were supplied, the first of equals.

    supplied (answer_id, chunk_id). An answer that is no refusal and keeps none becomes one, insufficient_context.
    """
    each = answers.select("answer_id", F.posexplode("cited").alias("pos", "chunk_id")).groupBy("answer_id", "chunk_id").agg(F.min("pos").alias("pos"))
    kept = each.join(supplied.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"])
    listed = kept.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"))
    none = F.array().cast("array<string>")
    out = answers.join(listed, "answer_id", "left").withColumn("citations", F.coalesce("citations", none))
    empty = ~F.col("refused") & (F.size("citations") == 0)
    return out.select("answer_id", "citations", (F.col("refused") | empty).alias("refused"), F.when(empty, "insufficient_context").when(F.col("refused"), "model_refusal").alias("refusal_reason"))


def mention_support(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """(answer_id, citations, unverified): provisions that an answer names, checked against what it cites.

    answers (answer_id, text, citations), supplied (answer_id, rank, chunk_id, section, sub_section, clause, rule,
    sub_rule, refers_to, refers_to_provisions, text). A named provision is backed by a cited chunk that is it, refers
    to it or names it; else supplied chunks that are it are cited, if it has a sub-number; else it is unverified.
    Each citation counts for later mentions, so an answer is folded in order.
    """
    named = answers.select("answer_id", F.col("citations"), mentions(F.col("text")).alias("mentions"))
    kind = F.when(F.coalesce("section", F.lit("")) != "", "section").when(F.coalesce("rule", F.lit("")) != "", "rule")
    number = F.upper(F.when(kind == "section", F.col("section")).otherwise(F.col("rule")))
    sub = F.when(kind == "section", F.coalesce("sub_section", "clause")).otherwise(F.col("sub_rule"))
    said = F.transform(mentions(F.col("text")), lambda m: F.concat_ws("|", m["kind"], m["number"], F.coalesce(m["sub"], F.lit(""))))
    refs = F.transform(F.concat(F.coalesce("refers_to", F.array().cast("array<string>")), F.coalesce("refers_to_provisions", F.array().cast("array<string>"))), F.lower)
    rows = supplied.select("answer_id", F.struct("rank", "chunk_id", kind.alias("kind"), number.alias("number"), sub.alias("sub"), said.alias("said"), refs.alias("refs")).alias("c"))
    grouped = named.join(rows.groupBy("answer_id").agg(F.array_sort(F.collect_list("c")).alias("chunks")), "answer_id", "left")

    none = F.array().cast("array<string>")
    chunks = F.coalesce("chunks", F.array().cast(grouped.schema["chunks"].dataType))
    kept = "struct<citations:array<string>,unverified:array<string>>"

    def step(acc: Column, m: Column) -> Column:
        cites, sub = acc["citations"], F.coalesce(m["sub"], F.lit(""))
        label = F.concat(m["kind"], F.lit(" "), F.lower(m["number"]), F.when(sub == "", "").otherwise(F.concat(F.lit("("), sub, F.lit(")"))))
        key = F.concat_ws("|", m["kind"], m["number"], sub)
        is_it = lambda c: F.coalesce((c["kind"] == m["kind"]) & (c["number"] == m["number"]) & ((sub == "") | c["sub"].isNull() | (c["sub"] == sub)), F.lit(False))
        backed = F.exists(chunks, lambda c: F.array_contains(cites, c["chunk_id"]) & (is_it(c) | F.array_contains(c["refs"], label) | F.array_contains(c["said"], key)))
        more = F.when(sub == "", none).otherwise(F.transform(F.filter(chunks, lambda c: is_it(c) & ~F.array_contains(cites, c["chunk_id"])), lambda c: c["chunk_id"]))
        unknown = F.when(backed | (F.size(more) > 0), none).otherwise(F.array(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1000))))
        return F.struct(F.when(backed, cites).otherwise(F.concat(cites, more)).alias("citations"), F.concat(acc["unverified"], unknown).alias("unverified")).cast(kept)

    folded = F.aggregate("mentions", F.struct(F.coalesce("citations", none).alias("citations"), none.alias("unverified")).cast(kept), step)
    return grouped.select("answer_id", folded.alias("f")).select("answer_id", "f.*")


def stub_answers(contexts: DataFrame) -> DataFrame:
    """What a model without a network answers: (query_id, answer, cited, refused), citing the first context document."""
    first = F.regexp_extract("context", r'<document index="1" chunk_id="([^"]*)"', 1)
    found = first != ""
    return contexts.select(
        "query_id",
        F.when(found, F.concat(F.lit("See "), first, F.lit("."))).otherwise("The context does not answer this.").alias("answer"),
        F.when(found, F.array(first)).otherwise(F.array().cast("array<string>")).alias("cited"),
        (~found).alias("refused"),
    )
