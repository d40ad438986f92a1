"""Metadata signals: further rankings drawn from a question's wording and the chunks' metadata, fused by RRF.

Queries (query_id, text). Each signal gives (query_id, pos, chunk_id) in its own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches, matches_any
from .provisions import lookup
from .retrieval import rrf, sent

# Wordings that show what a question asks for, the signals' weights, and how definitions, quotations and
# other enactments are written.
DEFINITION_INTENT = [r"\bwhat (?:counts as|is meant by)\b", r"\bmeaning of\b", r"\bdefinition of\b", r"\bdefines?\b", r"\bwhat does .{1,60} mean\b"]
COMMENCEMENT_INTENT = [r"\b(?:come|comes|came|coming) into (?:force|effect)\b", r"\bcommencement\b", r"\bcommence[sd]?\b", r"\beffective (?:from|date)\b"]
CORRECTION_INTENT = [r"\bcorrect(?:ed|ion|ions|s)?\b", r"\bcorrigend", r"\berrat", r"\bG\.?\s?S\.?\s?R\.?\s*892"]
COMMENCEMENT_TITLES = ["commencement"]
COMMENCEMENT_TARGETS = {"rules": ["rules"], "act": ["act", "notification"]}
WEIGHTS = {"citations": 1.0, "definitions": 1.0, "commencement": 1.0, "corrections": 1.0, "links": 0.0}
SIGNALS = ("citations", "definitions", "commencement", "corrections", "links")
DEFINED = r"^\s*(?:\([a-z0-9]+\)\s*)*[“\"]([^”\"]+)[”\"]\s+(?:means|includes)\b"
QUOTED = r"[“\"']([^”\"']{2,60})[”\"']"
OTHER_ACT = r"^\s*of\s+(?:the\s+)?(?!Act\b)[A-Z][A-Za-z()'’,&\s-]{0,200}?\b(?:Act|Code)\b"
THIS_ACT = r"^\s*of\s+(?:this Act|the Act|the said Act|the Digital Personal Data Protection Act)"


def is_external(after: Column) -> Column:
    """Whether the text behind a section number names another enactment."""
    return after.rlike(OTHER_ACT) & ~after.rlike(THIS_ACT)


# Ways to cite, most specific first.
CITATION_FORMS = (
    ("verbose", r"\bsub-?\s?sections?\s+((?:\([a-z0-9]+\)(?:\s*(?:,|and|or)\s*)?)+)\s*of\s+section\s+(\d+[A-Z]?)"),
    ("section", r"\bsections?\s+(\d+[A-Z]?)((?:\s?\([a-z0-9]+\))*)"),
    ("item", r"\bitem\s+(\d+)(?:\s+of\s+Part\s+([A-Z]))?\s+of\s+the\s+(First|Second|Third|Fourth|Fifth|Sixth|Seventh)\s+Schedule"),
    ("part", r"\bPart\s+([A-Z])\s+of\s+the\s+(First|Second|Third|Fourth|Fifth|Sixth|Seventh)\s+Schedule"),
    ("schedule", r"\b(First|Second|Third|Fourth|Fifth|Sixth|Seventh)\s+Schedule\b"),
    ("rule", r"\brules?\s+(\d+)((?:\s?\([a-z0-9]+\))*)"),
)


def _keys(kind: str, m: Column, tail: Column) -> Column:
    """The key (kind, a, b, c) that a match of a form cites; null where it is a section of another act."""
    group = lambda i: F.regexp_extract(m, "(?i)" + dict(CITATION_FORMS)[kind], i)
    in_brackets = lambda i: F.regexp_extract_all(group(i), F.lit(r"\(([a-z0-9]+)\)"), F.lit(1))
    schedule = lambda i: F.concat(F.initcap(group(i)), F.lit(" Schedule"))
    key = lambda name, a, b="", c="": F.struct(*(x.alias(n) for x, n in zip((F.lit(name), a, *(F.lit(v) if isinstance(v, str) else v for v in (b, c))), ("kind", "a", "b", "c"))))
    labels = F.array_join(F.transform(in_brackets(1), lambda s: F.concat(F.lit("section "), group(2), F.lit("("), s, F.lit(")"))), ";")
    out = {
        "verbose": lambda: key("label", labels),
        "section": lambda: key("label", F.concat(F.lit("section "), group(1), F.replace(group(2), F.lit(" ")))),
        "item": lambda: key("schedule", schedule(3), group(2), group(1)),
        "part": lambda: key("schedule", schedule(2), F.upper(group(1))),
        "schedule": lambda: key("schedule", schedule(1)),
        "rule": lambda: key("rule", group(1), F.coalesce(F.try_element_at(in_brackets(2), F.lit(1)), F.lit(""))),
    }[kind]()
    return F.when(~is_external(tail), out) if kind in ("verbose", "section") else out


def cited(queries: DataFrame) -> DataFrame:
    """(query_id, n, kind, a, b, c): what each question cites. Later forms skip text that an earlier one took."""
    found = [F.transform(matches(F.col("text"), f"(?iU){pattern}"), lambda m: F.struct(F.lit(i).alias("form"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"))) for i, (_, pattern) in enumerate(CITATION_FORMS)]
    rows = queries.select("query_id", "text", F.concat(*found).alias("found"))
    free = lambda acc, m: ~F.exists(acc, lambda t: (m["start"] < t["end"]) & (t["start"] < m["end"]))
    taken = F.aggregate("found", F.array().cast(rows.schema["found"].dataType), lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    each = rows.select("query_id", "text", F.posexplode(taken).alias("n", "m"))
    tail = F.col("text").substr(F.col("m.end") + 1, F.lit(250))
    key = F.coalesce(*(F.when(F.col("m.form") == i, _keys(kind, F.col("m.match"), tail)) for i, (kind, _) in enumerate(CITATION_FORMS)))
    return each.select("query_id", "n", key.alias("key")).where("key is not null").select("query_id", "n", "key.*")


def citation_targets(chunks: DataFrame) -> DataFrame:
    """(kind, a, b, c, chunk_id, ord, dup): chunks by the keys that cite rules and schedules.

    A rule without a sub-rule stands twice under its rule, a row without a part twice under its schedule; both count
    when a citation is judged too broad.
    """
    rules = chunks.where("doc_type = 'rules' and rule is not null").select("chunk_id", "ord", F.col("rule").alias("a"), F.coalesce("sub_rule", F.lit("")).alias("sub"))
    rows = chunks.where("schedule is not null and doc_type != 'corrigendum'").select("chunk_id", "ord", F.col("schedule").alias("a"), F.coalesce("part", F.lit("")).alias("part"), F.coalesce("item", F.lit("")).alias("item"))
    e = F.lit("")
    keyed = lambda df, kind, b, c, dup: df.select(F.lit(kind).alias("kind"), "a", b.alias("b"), c.alias("c"), "chunk_id", "ord", F.lit(dup).alias("dup"))
    return (
        keyed(rules, "rule", e, e, 0).unionByName(keyed(rules, "rule", F.col("sub"), e, 1))
        .unionByName(keyed(rows, "schedule", e, e, 0)).unionByName(keyed(rows, "schedule", F.col("part"), e, 1)).unionByName(keyed(rows, "schedule", F.col("part"), F.col("item"), 2))
    )


def citations(queries: DataFrame, chunks: DataFrame, max_chunks: int = 5) -> DataFrame:
    asked = cited(queries)
    labels = asked.where("kind = 'label'").select("query_id", "n", F.posexplode(F.split("a", ";")).alias("i", "label"))
    by_label = labels.join(lookup(labels.select("label").distinct(), chunks), "label").select("query_id", "n", "i", "ord", F.lit(0).alias("dup"), "chunk_id")
    by_key = asked.join(citation_targets(chunks), ["kind", "a", "b", "c"]).select("query_id", "n", F.lit(0).alias("i"), "ord", "dup", "chunk_id")
    hits = by_label.unionByName(by_key)
    hits = hits.withColumn("size", F.count("*").over(Window.partitionBy("query_id", "n"))).where(F.col("size") <= max_chunks)
    return _numbered(hits, "n", "i", "ord", "dup")


def _numbered(hits: DataFrame, *order: str) -> DataFrame:
    """(query_id, pos, chunk_id), the first of equals."""
    first = hits.groupBy("query_id", "chunk_id").agg(F.min(F.struct(*order)).alias("at"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")).alias("pos"), "chunk_id")


def definitions(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that define a quoted term, else, where a meaning is asked for, the longest defined term in the question."""
    term = F.lower(F.regexp_extract("text", DEFINED, 1))
    defined = chunks.where(F.col("text").rlike(DEFINED)).select(term.alias("term"), "chunk_id", "ord")
    quoted = queries.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))).alias("i", "q"))
    by_quote = quoted.select("query_id", "i", F.lower("q").alias("term")).join(defined, "term").select("query_id", "i", "ord", "chunk_id")
    asking = queries.where(matches_any(F.col("text"), DEFINITION_INTENT)).join(by_quote.select("query_id").distinct(), "query_id", "left_anti")
    terms = defined.groupBy("term").agg(F.min("ord").alias("first"))
    inside = asking.join(sent(terms, terms.count()), F.contains(F.lower(F.col("text")), F.col("term")))
    best = inside.groupBy("query_id").agg(F.max_by("term", F.struct(F.length("term"), -F.col("first"))).alias("term"))
    by_term = best.join(defined, "term").select("query_id", F.lit(0).alias("i"), "ord", "chunk_id")
    return _numbered(by_quote.unionByName(by_term), "i", "ord")


def commencements(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Commencement provisions, of the one document that the question names or of all."""
    q = queries.where(matches_any(F.col("text"), COMMENCEMENT_INTENT))
    named = F.array_compact(F.array(*(F.when(F.col("text").rlike(rf"(?i)\b{n}\b"), F.lit(n)) for n in COMMENCEMENT_TARGETS)))
    allowed = F.lit(None).cast("array<string>")
    for name, types in COMMENCEMENT_TARGETS.items():
        allowed = F.when((F.size("named") == 1) & (F.col("named")[0] == name), F.array(*map(F.lit, types))).otherwise(allowed)
    q = q.withColumn("named", named).select("query_id", F.when(F.size("named") == 1, allowed).alias("allowed"))
    found = chunks.where(matches_any(F.coalesce("title", F.lit("")), COMMENCEMENT_TITLES)).select("chunk_id", "ord", "doc_type")
    hits = q.join(sent(found, found.count()), F.col("allowed").isNull() | F.array_contains("allowed", F.col("doc_type")))
    return _numbered(hits, "ord")


def corrections(queries: DataFrame, ranking: DataFrame, chunks: DataFrame, depth: int = 10) -> DataFrame:
    """For questions about corrections: what the first `depth` results correct, and what corrects them."""
    q = queries.where(matches_any(F.col("text"), CORRECTION_INTENT)).select("query_id")
    head = ranking.where(F.col("rank") <= depth).join(q, "query_id", "left_semi").select("query_id", "rank", F.col("chunk_id").alias("from_id"))
    edge = chunks.select("chunk_id", "ord", F.posexplode("corrects").alias("i", "target"))
    out = edge.select(F.col("chunk_id").alias("from_id"), F.lit(0).alias("side"), F.col("i").cast("bigint").alias("i"), F.col("target").alias("chunk_id"))
    back = edge.select(F.col("target").alias("from_id"), F.lit(1).alias("side"), F.col("ord").cast("bigint").alias("i"), F.col("chunk_id"))
    return _numbered(head.join(out.unionByName(back), "from_id"), "rank", "side", "i")


def links(ranking: DataFrame, chunks: DataFrame, depth: int = 5) -> DataFrame:
    """Between schedule rows and their parent rules and sections, for the first `depth` results."""
    head = ranking.where(F.col("rank") <= depth).select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", "doc_type", "section", "sub_section", "schedule", "see_rules", "refers_to_provisions"), "chunk_id")
    row = F.expr("schedule is not null and doc_type != 'corrigendum'")
    rules = chunks.where("doc_type = 'rules' and rule is not null").select(F.col("chunk_id").alias("r_id"), F.col("ord").alias("r_ord"), F.col("rule").alias("r_rule"), F.lower("text").alias("r_text"))
    up = head.where(row).select("query_id", "rank", "schedule", F.posexplode("see_rules").alias("i", "r_rule")).join(rules, "r_rule").where(F.contains(F.col("r_text"), F.lower("schedule")))
    up = up.select("query_id", "rank", F.lit(0).alias("side"), "i", F.col("r_ord").alias("o"), F.col("r_id").alias("chunk_id"))
    cites = head.where(row).select("query_id", "rank", F.posexplode("refers_to_provisions").alias("i", "label"))
    across = cites.join(lookup(cites.select("label").distinct(), chunks), "label").select("query_id", "rank", F.lit(1).alias("side"), "i", F.col("ord").alias("o"), "chunk_id")
    rows = chunks.where(row).select(F.col("chunk_id").alias("s_id"), F.col("ord").alias("s_ord"), F.explode("refers_to_provisions").alias("label"))
    label = F.concat(F.lit("section "), F.col("section"), F.coalesce(F.concat(F.lit("("), F.col("sub_section"), F.lit(")")), F.lit("")))
    down = head.where("doc_type = 'act' and section is not null").withColumn("label", label).join(rows, "label").select("query_id", "rank", F.lit(2).alias("side"), F.lit(0).alias("i"), F.col("s_ord").alias("o"), F.col("s_id").alias("chunk_id"))
    return _numbered(up.unionByName(across).unionByName(down), "rank", "side", "i", "o")


def fuse(ranking: DataFrame, signals: dict[str, DataFrame], chunks: DataFrame, condition: Column | None = None, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """The ranking fused with each signal of weight above 0. A query without any signal keeps its scores.

    Signal chunks must meet the condition. Pairwise signals (corrections, links) keep their order, the others follow
    the ranking, with what it lacks behind.
    """
    weights = WEIGHTS if weights is None else weights
    allowed = chunks.where(condition).select("chunk_id") if condition is not None else chunks.select("chunk_id")
    lists = None
    for i, name in enumerate(SIGNALS, 1):
        if name not in signals or weights.get(name, 0) <= 0:
            continue
        rows = signals[name].join(allowed, "chunk_id", "left_semi")
        own = rows.select("query_id", "chunk_id", "pos").join(ranking.select("query_id", "chunk_id", F.col("rank").alias("r")), ["query_id", "chunk_id"], "left")
        key = [F.col("pos")] if name in ("corrections", "links") else [F.coalesce("r", F.lit(2**31 - 1)), F.col("pos")]
        part = own.select("query_id", F.lit(i).alias("list_idx"), F.row_number().over(Window.partitionBy("query_id").orderBy(*key)).alias("rank"), "chunk_id", F.lit(float(weights[name])).alias("weight"))
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        return ranking.select("query_id", "chunk_id", "score", "rank")
    fired = lists.select("query_id").distinct()
    base = ranking.join(fired, "query_id", "left_semi").select("query_id", F.lit(0).alias("list_idx"), "rank", "chunk_id", F.lit(1.0).alias("weight"))
    fused = rrf(base.unionByName(lists), k)
    plain = ranking.join(fired, "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank")
    return plain.unionByName(fused.select("query_id", "chunk_id", "score", "rank"))
