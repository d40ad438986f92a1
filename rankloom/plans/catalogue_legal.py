"""Queries over the small legal corpus: provisions, signals, expansion, answers and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import answers, boosts, evaluation, provisions, segments
from ..operators import retrieval as R
from . import sample as S
from .catalogue_data import ORACLE, QUERIES, query
from . import evaluate, ingest
from .retrieve import Settings, retrieve

__all__ = ["ORACLE", "QUERIES"]
AS_OF = "2026-12-01"
CHUNKS, ASKED, RANKED = S.cte("chunks", S.CHUNKS, S.CHUNK_DDL), S.cte("questions", S.QUESTIONS, S.QUESTION_DDL), S.cte("ranking", S.RANKING, S.RANKING_DDL)
PROBES = [("1", "2", None), ("2", None, "t"), ("8", "5", None), ("9", None, None), ("27", "1", "a"), ("27", "1", "d"), ("6", None, None), ("40", None, None), (None, None, None)]
PROBE_DDL = "section string, sub_section string, clause string"
LABELS = [("section 9",), ("section 9(3)",), ("section 27(1)(a)",), ("section 27(1)(z)",), ("section 40",), ("rule 4",), ("section 8(5)(a)",)]


@query(f"""WITH {S.cte('p', PROBES, PROBE_DDL)}, {S.cte('c', S.CALENDAR, S.CALENDAR_DDL)}
    SELECT section, sub_section, clause, coalesce(
        (SELECT min(in_force_date) FROM c WHERE c.section = p.section AND c.sub_section IS NOT DISTINCT FROM p.sub_section AND c.clause IS NOT DISTINCT FROM p.clause),
        (SELECT min(in_force_date) FROM c WHERE c.section = p.section AND c.sub_section IS NOT DISTINCT FROM p.sub_section AND c.clause IS NULL),
        (SELECT min(in_force_date) FROM c WHERE c.section = p.section AND c.sub_section IS NULL AND c.clause IS NULL),
        (SELECT min(in_force_date) FROM c WHERE c.section = p.section AND p.sub_section IS NULL HAVING count(DISTINCT in_force_date) = 1), DATE '2030-01-01') AS in_force_date FROM p""")
def commencement_date(spark, d):
    return provisions.commencement(spark.createDataFrame(PROBES, PROBE_DDL), spark.createDataFrame(S.CALENDAR, S.CALENDAR_DDL), "2030-01-01")


RULE_DATES = [("4", S._D2), ("5", S._D3), ("6", S._D1)]
SEEN = [("a", ["4", "5"]), ("b", ["6", "4"]), ("c", ["9", "5"])]


@query(f"""WITH {S.cte('r', RULE_DATES, 'rule string, in_force_date date')}, {S.cte('s', SEEN, 'chunk_id string, see_rules array<string>')}
    SELECT chunk_id, min(in_force_date) AS in_force_date, count_if(in_force_date IS NULL)::BIGINT AS n_missing FROM (SELECT chunk_id, unnest(see_rules) AS rule FROM s) LEFT JOIN r USING (rule) GROUP BY chunk_id""")
def schedule_min_date(spark, d):
    return provisions.earliest_rule_date(spark.createDataFrame(SEEN, "chunk_id string, see_rules array<string>"), spark.createDataFrame(RULE_DATES, "rule string, in_force_date date"))


LOOKUP_SQL = r"""parts AS (SELECT label, nullif(regexp_extract(label, '^section (\d+[A-Z]?)', 1), '') AS s, nullif(regexp_extract(label, '^section \d+[A-Z]?\(([a-z0-9]+)\)', 1), '') AS ss, nullif(regexp_extract(label, '^section \d+[A-Z]?\([a-z0-9]+\)\(([a-z0-9]+)\)$', 1), '') AS cl FROM labels),
    hit AS (SELECT *, max(coalesce(clause = cl, false)) OVER (PARTITION BY label) AS any_exact FROM parts JOIN chunks ON doc_type = 'act' AND section = s AND (ss IS NULL OR sub_section = ss)),
    looked AS (SELECT label, chunk_id, ord FROM hit WHERE cl IS NULL OR coalesce(clause = cl, false) OR (NOT any_exact AND clause IS NULL))"""


@query(f"WITH {CHUNKS}, {S.cte('labels', LABELS, 'label string')}, {LOOKUP_SQL} SELECT * FROM looked")
def provision_lookup(spark, d):
    return provisions.lookup(spark.createDataFrame(LABELS, "label string"), S.chunks(spark))


@query(f"""WITH {CHUNKS}, {S.cte('p', S.PENALTIES, S.PENALTY_DDL)}
    SELECT chunk_id, (SELECT arg_max(p.penalty, row_ord * 1000 + ref_ord) FROM p WHERE p.section = c.section AND (p.sub_section IS NULL OR p.sub_section = c.sub_section)) AS penalty FROM chunks c WHERE c.section IS NOT NULL""")
def penalty_attach(spark, d):
    rows = S.chunks(spark).where("section is not null").withColumn("penalty", F.lit(None).cast("string"))
    return provisions.attach_penalties(rows, spark.createDataFrame(S.PENALTIES, S.PENALTY_DDL)).select("chunk_id", "penalty")


PLACES = [(1, 30, 31, 4), (2, 30, 30, 9), (3, 31, 31, 2), (4, 31, None, None), (5, 30, 30, 6)]
PATCH_ROWS = [("p1", 30, 5), ("p2", 31, 2), ("p3", 29, 1)]


@query(f"""WITH {S.cte('p', PATCH_ROWS, 'patch_id string, page int, line int')}, {S.cte('l', PLACES, 'place_ord int, page int, page_end int, line_no int')},
    j AS (SELECT patch_id, place_ord, abs(coalesce(line_no, 1000000) - line) AS far FROM p JOIN l ON l.page <= p.page AND p.page <= coalesce(l.page_end, l.page))
    SELECT patch_id, place_ord, far AS distance, n AS n_hits FROM (SELECT *, count(*) OVER (PARTITION BY patch_id) AS n, row_number() OVER (PARTITION BY patch_id ORDER BY far, place_ord) AS r FROM j) WHERE r = 1""")
def nearest_line_patch(spark, d):
    return segments.nearest_place(spark.createDataFrame(PATCH_ROWS, "patch_id string, page int, line int"), spark.createDataFrame(PLACES, "place_ord int, page int, page_end int, line_no int"))


# -- signals ------------------------------------------------------------------------------------------------------


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


DEFINED_SQL = rf"""defined AS (SELECT lower(regexp_extract(text, '{boosts.DEFINED}', 1)) AS term, chunk_id, ord FROM chunks WHERE regexp_matches(text, '{boosts.DEFINED}')),
    quoted AS (SELECT query_id, unnest(regexp_extract_all(text, '{boosts.QUOTED.replace("'", "''")}', 1)) AS q, generate_subscripts(regexp_extract_all(text, '{boosts.QUOTED.replace("'", "''")}', 1), 1) AS i FROM questions),
    by_quote AS (SELECT query_id, i, ord, chunk_id FROM quoted JOIN defined ON lower(q) = term),
    asking AS (SELECT * FROM questions WHERE regexp_matches(text, '{any_of(boosts.DEFINITION_INTENT)}') AND query_id NOT IN (SELECT query_id FROM by_quote)),
    best AS (SELECT query_id, term FROM asking, (SELECT term, min(ord) AS o FROM defined GROUP BY 1) WHERE contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, o) = 1),
    hits AS (SELECT * FROM by_quote UNION ALL SELECT query_id, 0, ord, chunk_id FROM best JOIN defined USING (term))"""


@query(f"WITH {CHUNKS}, {ASKED}, {DEFINED_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i, ord)::INTEGER AS pos, chunk_id FROM hits")
def boost_definitions(spark, d):
    return boosts.definitions(S.questions(spark), S.chunks(spark))


COMMENCE_SQL = f"""q AS (SELECT query_id, regexp_matches(text, '(?i)\\brules\\b') AS r, regexp_matches(text, '(?i)\\bact\\b') AS a FROM questions WHERE regexp_matches(text, '{any_of(boosts.COMMENCEMENT_INTENT)}')),
    hits AS (SELECT query_id, ord, chunk_id FROM q, chunks WHERE regexp_matches(coalesce(title, ''), '(?i)commencement') AND (r = a OR (r AND doc_type = 'rules') OR (a AND doc_type IN ('act', 'notification'))))"""


@query(f"WITH {CHUNKS}, {ASKED}, {COMMENCE_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ord)::INTEGER AS pos, chunk_id FROM hits")
def boost_commencement(spark, d):
    return boosts.commencements(S.questions(spark), S.chunks(spark))


CORRECT_SQL = f"""head AS (SELECT r.* FROM ranking r JOIN questions q USING (query_id) WHERE rank <= 10 AND regexp_matches(q.text, '{any_of(boosts.CORRECTION_INTENT)}')),
    edge AS (SELECT chunk_id, unnest(corrects) AS target FROM chunks),
    hits AS (SELECT query_id, rank, 0 AS side, target AS chunk_id FROM head JOIN edge USING (chunk_id) UNION ALL SELECT query_id, rank, 1, e.chunk_id FROM head h JOIN edge e ON e.target = h.chunk_id)"""


@query(f"WITH {CHUNKS}, {ASKED}, {RANKED}, {CORRECT_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, side)::INTEGER AS pos, chunk_id FROM hits")
def boost_corrections(spark, d):
    return boosts.corrections(S.questions(spark), S.ranking(spark), S.chunks(spark))


@query(f"""WITH {CHUNKS}, {RANKED}, head AS (SELECT query_id, rank, c.* FROM ranking JOIN chunks c USING (chunk_id) WHERE rank <= 5), s AS (SELECT * FROM head WHERE schedule IS NOT NULL AND doc_type <> 'corrigendum'),
    labels AS (SELECT DISTINCT unnest(refers_to_provisions) AS label FROM s), {LOOKUP_SQL},
    up AS (SELECT query_id, rank, 0 AS side, r.ord AS o, r.chunk_id FROM (SELECT *, unnest(see_rules) AS see FROM s) h JOIN chunks r ON r.doc_type = 'rules' AND r.rule = see AND contains(lower(r.text), lower(h.schedule))),
    across AS (SELECT query_id, rank, 1 AS side, l.ord AS o, l.chunk_id FROM (SELECT *, unnest(refers_to_provisions) AS label FROM s) h JOIN looked l USING (label)),
    down AS (SELECT query_id, rank, 2 AS side, x.ord AS o, x.chunk_id FROM head h JOIN (SELECT ord, chunk_id, unnest(refers_to_provisions) AS label FROM chunks WHERE schedule IS NOT NULL AND doc_type <> 'corrigendum') x
        ON h.doc_type = 'act' AND x.label = 'section ' || h.section || CASE WHEN h.sub_section IS NULL THEN '' ELSE '(' || h.sub_section || ')' END),
    f AS (SELECT query_id, chunk_id, min(rank * 100000 + side * 10000 + o) AS k FROM (SELECT * FROM up UNION ALL SELECT * FROM across UNION ALL SELECT * FROM down) GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k)::INTEGER AS pos, chunk_id FROM f""")
def boost_links(spark, d):
    return boosts.links(S.ranking(spark), S.chunks(spark))


@query(f"""WITH {CHUNKS}, {ASKED}, {RANKED}, {CORRECT_SQL.replace('hits AS', 'c_hits AS')}, {COMMENCE_SQL.replace('hits AS', 'm_hits AS')},
    lists AS (SELECT query_id, 3 AS idx, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(r.rank, 2147483647), m.ord) AS rank FROM m_hits m LEFT JOIN ranking r USING (query_id, chunk_id)
        UNION ALL SELECT query_id, 4, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, side) FROM c_hits),
    every AS (SELECT * FROM lists UNION ALL SELECT query_id, 0, chunk_id, rank FROM ranking WHERE query_id IN (SELECT query_id FROM lists)),
    fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(idx * 1000 + rank) AS first FROM every GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INTEGER AS rank FROM fused
    UNION ALL SELECT query_id, chunk_id, score, rank FROM ranking WHERE query_id NOT IN (SELECT query_id FROM lists)""")
def boost_fusion(spark, d):
    q, r, c = S.questions(spark), S.ranking(spark), S.chunks(spark)
    return boosts.fuse(r, {"commencement": boosts.commencements(q, c), "corrections": boosts.corrections(q, r, c)}, c)


@query()
def retrieve_full(spark, d):
    s = Settings(mode="bm25", k=4, candidates=10, weights=boosts.WEIGHTS, rerank_top=2, cross_refs=True)
    return retrieve(S.chunks(spark), None, S.questions(spark), s)


# -- answers ------------------------------------------------------------------------------------------------------


def _case(mapping: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {S.literal(k)} THEN {S.literal(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


_ENTRY = _case(answers.ENTRY_LABELS, "schedule", "'item'")
PIN = f"""CASE WHEN doc_type = 'corrigendum' THEN CASE WHEN regexp_replace(chunk_id, '^[^:]*:', '') <> 'preamble' THEN coalesce(gsr_no, 'None') || ', item ' || regexp_replace(chunk_id, '^[^:]*:', '') ELSE coalesce(gsr_no, 'None') END
    WHEN doc_type = 'notification' THEN coalesce(gsr_no, 'None') || coalesce(', clause (' || clause || ')', '')
    WHEN schedule IS NOT NULL AND item LIKE 'Note%' THEN schedule || coalesce(', Part ' || part, '') || ', ' || item
    WHEN schedule IS NOT NULL THEN schedule || coalesce(', Part ' || part, '') || coalesce(', ' || {_ENTRY} || ' ' || CASE WHEN {_ENTRY} = 'clause' THEN '(' || item || ')' ELSE item END, '') || CASE WHEN illustration THEN ', Illustration' ELSE '' END
    WHEN section IS NOT NULL THEN 'Section ' || section || coalesce('(' || sub_section || ')', '') || coalesce('(' || clause || ')', '')
    WHEN rule IS NOT NULL THEN 'Rule ' || rule || coalesce('(' || sub_rule || ')', '') || CASE WHEN illustration THEN ', Illustration' ELSE '' END
    WHEN doc_type = 'act' THEN 'Act, long title' WHEN doc_type = 'rules' THEN 'Rules, preamble' ELSE chunk_id END"""
STATUS = f"""CASE WHEN in_force_date IS NULL THEN 'commencement date unknown' WHEN in_force_date <= DATE '{AS_OF}' THEN 'IN FORCE on {AS_OF} (since ' || in_force_date || ')' ELSE 'NOT YET IN FORCE on {AS_OF} (comes into force on ' || in_force_date || ')' END"""


@query(f"WITH {CHUNKS} SELECT chunk_id, {PIN} AS pinpoint FROM chunks")
def pinpoint_labels(spark, d):
    return S.chunks(spark).select("chunk_id", answers.pinpoint().alias("pinpoint"))


@query(f"WITH {CHUNKS} SELECT chunk_id, in_force_date <= DATE '{AS_OF}' AS in_force, {STATUS} AS status, (year(in_force_date) * 10000 + month(in_force_date) * 100 + day(in_force_date))::INTEGER AS number FROM chunks")
def in_force_status(spark, d):
    day = F.lit(AS_OF).cast("date")
    return S.chunks(spark).select("chunk_id", dates.in_force(F.col("in_force_date"), day).alias("in_force"), dates.force_status(F.col("in_force_date"), day).alias("status"), dates.date_number(F.col("in_force_date")).alias("number"))


def _esc(c: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), '''', '&#x27;')" if quotes else out


@query(f"""WITH {CHUNKS}, {RANKED}, j AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, c.*, {PIN} AS pin, {STATUS} AS status FROM ranking JOIN chunks c USING (chunk_id)),
    docs AS (SELECT query_id, i, '<document index="' || i || '" chunk_id="' || {_esc('chunk_id', True)} || '" pinpoint="' || {_esc('pin', True)} || '" source="' || {_esc(_case(answers.DOC_LABELS, 'doc_type', 'doc_type'), True)} || '" in_force_date="' || coalesce(in_force_date::VARCHAR, 'unknown') || '" status="' || {_esc('status', True)} || '"'
        || coalesce(' corrected_by="' || {_esc('corrected_by', True)} || '"', '') || '>' || chr(10) || coalesce('<title>' || {_esc('title')} || '</title>' || chr(10), '') || coalesce('<note>This text includes the corrections made by ' || corrected_by || '.</note>' || chr(10), '')
        || '<text>' || {_esc('text')} || '</text>' || chr(10) || '</document>' AS doc FROM j)
    SELECT query_id, string_agg(doc, chr(10) || chr(10) ORDER BY i) AS context FROM docs GROUP BY query_id""")
def render_context(spark, d):
    return answers.context(S.ranking(spark), S.chunks(spark), AS_OF)


ANSWERS = [("a1", "See Section 9(1) and rule 10(1); section 40 says more.", False, ["act:s9(1)", "nowhere", "act:s9(1)"]), ("a2", "None.", True, []), ("a3", "As Section 8(5) says.", False, ["nowhere"]), ("a4", "Rule 8(3).", False, ["rules:r4", "rules:r8(3)"])]
ANSWER_DDL = "answer_id string, text string, refused boolean, cited array<string>"
SUPPLIED = [("a1", 1, "act:s9(1)"), ("a1", 2, "rules:r10(1)"), ("a2", 1, "act:s9(1)"), ("a3", 1, "act:s8(5)"), ("a4", 1, "rules:r8(3)"), ("a4", 2, "rules:r4")]
SUPPLIED_DDL = "answer_id string, rank int, chunk_id string"


@query(f"""WITH {S.cte('a', ANSWERS, ANSWER_DDL)}, {S.cte('s', SUPPLIED, SUPPLIED_DDL)},
    e AS (SELECT answer_id, unnest(cited) AS chunk_id, generate_subscripts(cited, 1) AS pos FROM a),
    k AS (SELECT answer_id, list(chunk_id ORDER BY pos) AS citations FROM (SELECT answer_id, chunk_id, min(pos) AS pos FROM e SEMI JOIN s USING (answer_id, chunk_id) GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT answer_id, coalesce(citations, []) AS citations, refused, NOT refused AND coalesce(len(citations), 0) = 0 AS empty FROM a LEFT JOIN k USING (answer_id))
    SELECT answer_id, array_to_string(citations, ' ') AS citations, refused OR empty AS refused, CASE WHEN empty THEN 'insufficient_context' WHEN refused THEN 'model_refusal' END AS refusal_reason FROM o""")
def citation_validation(spark, d):
    out = answers.valid_citations(spark.createDataFrame(ANSWERS, ANSWER_DDL), spark.createDataFrame(SUPPLIED, SUPPLIED_DDL))
    return out.withColumn("citations", F.array_join("citations", " "))


@query(f"WITH {RANKED} SELECT query_id, 'See ' || chunk_id || '.' AS answer, chunk_id AS cited, false AS refused FROM ranking WHERE rank = 1")
def stub_answer(spark, d):
    return answers.stub_answers(answers.context(S.ranking(spark), S.chunks(spark), AS_OF)).withColumn("cited", F.array_join("cited", " "))


# -- parsing ------------------------------------------------------------------------------------------------------


MARKED = [("d", 1, "aC"), ("d", 2, "or"), ("d", 3, " IndiaCode "), ("d", 4, "The act"), ("d", 5, "di"), ("d", 6, "x1"), ("d", 7, "[F. No. 1]"), ("d", 8, "end")]


@query(f"WITH {S.cte('r', MARKED, S.LINE_DDL)} SELECT doc_id, ord, text, row_number() OVER (ORDER BY ord)::INTEGER AS line_no FROM r WHERE trim(text) NOT IN ('aC', 'IndiaCode', 'di')")
def watermark_filter(spark, d):
    return segments.without_watermark(spark.createDataFrame(MARKED, S.LINE_DDL), ["IndiaCode"])


@query(f"WITH {S.cte('r', MARKED, S.LINE_DDL)} SELECT * FROM r WHERE ord >= (SELECT min(ord) FROM r WHERE contains(text, 'The')) AND ord < (SELECT min(ord) FROM r WHERE contains(text, '[F. No.'))")
def body_range(spark, d):
    return segments.body(spark.createDataFrame(MARKED, S.LINE_DDL), "The", "[F. No.")


# -- gates and golden set -----------------------------------------------------------------------------------------

BASE = [("recall_5", 0.80), ("mrr", 0.70), ("faithfulness", 4.2), ("gone", 1.0)]
NOW = [("recall_5", 0.741), ("mrr", 0.63), ("faithfulness", 4.3), ("fresh", 0.5)]
LIMITS = [("recall_5", 0.05, 0.01), ("mrr", 0.05, 0.01), ("faithfulness", 0.25, 0.15), ("gone", 0.05, 0.0), ("fresh", 0.05, 0.0)]


@query(f"""WITH {S.cte('b', BASE, 'metric string, value double')}, {S.cte('c', NOW, 'metric string, value double')}, {S.cte('l', LIMITS, 'metric string, max_drop double, tolerance double')},
    j AS (SELECT l.*, b.value AS baseline, c.value AS current FROM l LEFT JOIN b USING (metric) LEFT JOIN c USING (metric)),
    s AS (SELECT *, CASE WHEN baseline IS NULL THEN 'new' WHEN current IS NULL THEN 'missing' WHEN baseline - current > max_drop + tolerance + 1e-12 THEN 'fail' WHEN baseline - current < -1e-12 THEN 'improved' ELSE 'pass' END AS status FROM j)
    SELECT metric, baseline, current, round(current - baseline, 9) AS delta, status, status IN ('fail', 'missing') AS failed FROM s""")
def gate_checks(spark, d):
    v = "metric string, value double"
    return evaluation.gates(spark.createDataFrame(BASE, v), spark.createDataFrame(NOW, v), spark.createDataFrame(LIMITS, "metric string, max_drop double, tolerance double"))


GOLDEN = [("g1", "lookup", ["act:s9(1)"], True), ("g2", "lookup", [], True), ("g3", "unanswerable", [], True), ("g4", "odd", ["nowhere", "act:s9(1)", "act:s9(1)"], True), ("g1", "table", ["rules:r4"], True), ("g5", "unanswerable", [], False)]
GOLDEN_DDL = "id string, category string, gold_chunk_ids array<string>, answerable boolean"


@query(f"""WITH {CHUNKS}, {S.cte('g', GOLDEN, GOLDEN_DDL)}, e AS (SELECT id, unnest(gold_chunk_ids) AS chunk_id FROM g)
    SELECT id, 'unknown category' AS problem FROM g WHERE category NOT IN ('lookup', 'table', 'unanswerable') UNION ALL SELECT id, 'answerable without gold' FROM g WHERE category <> 'unanswerable' AND answerable AND len(gold_chunk_ids) = 0
    UNION ALL SELECT id, 'unanswerable marked answerable' FROM g WHERE category = 'unanswerable' AND answerable UNION ALL SELECT id, 'unknown chunk ' || chunk_id FROM e ANTI JOIN chunks USING (chunk_id)
    UNION ALL SELECT id, 'repeated chunk ' || chunk_id FROM e GROUP BY id, chunk_id HAVING count(*) > 1 UNION ALL SELECT id, 'duplicate id' FROM g GROUP BY id HAVING count(*) > 1""")
def golden_validation(spark, d):
    return evaluation.golden_problems(spark.createDataFrame(GOLDEN, GOLDEN_DDL), S.chunks(spark), ["lookup", "table", "unanswerable"])


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE doc_type IN ('act', 'rules') AND in_force_date <= DATE '{AS_OF}'")
def metadata_filter(spark, d):
    f = R.Filters.from_config({"doc_type": ["act", "rules"], "rule": None, "section": None, "in_force_only": True, "today": AS_OF})
    return S.chunks(spark).where(f.condition()).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, trim(coalesce(title, '') || chr(10) || text, ' ' || chr(10)) AS rendered, 'x' || chr(10) || 'y' AS untouched FROM chunks".replace(", 'x' || chr(10) || 'y' AS untouched", ""))
def rendered_chunks(spark, d):
    return S.chunks(spark).select("chunk_id", text.rendered(F.col("title"), F.col("text")).alias("rendered"))


# -- whole plans --------------------------------------------------------------------------------------------------


@query()
def ingest_act(spark, d):
    lines = spark.createDataFrame(S.LINES, S.LINE_DDL).where("doc_id = 'd1'")
    chunks = ingest.numbered_chunks(lines, "act", spark.createDataFrame(S.CALENDAR, S.CALENDAR_DDL), "2030-01-01", 40, "THE SCHEDULE")
    return ingest.with_penalties(chunks, spark.createDataFrame([(1, "Breach of section 2 Penalty: 5 rupees")], "ord int, text string"))


CALLS = [("m", 100, 10, 5, 1), ("m", 50, 5, 0, 0), ("n", 1, 1, 1, 1)]
CALL_DDL = "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint"


@query(f"""WITH {S.cte('c', CALLS, CALL_DDL)} SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens,
    sum(input_tokens + cache_read_tokens + cache_write_tokens)::BIGINT AS total_input, sum(input_tokens + cache_read_tokens + cache_write_tokens + output_tokens)::BIGINT AS total FROM c GROUP BY model""")
def usage_totals(spark, d):
    return evaluation.usage_totals(spark.createDataFrame(CALLS, CALL_DDL), "model")


WINDOWS, COVERS, WANTED = [("q", "w1", 1), ("q", "w2", 2), ("q", "w3", 6)], [("w2", "g1"), ("w2", "g2"), ("w3", "g3"), ("w1", "other")], [("q", "g1"), ("q", "g2"), ("q", "g3"), ("q", "g4")]


@query(f"""WITH {S.cte('w', WINDOWS, 'query_id string, chunk_id string, rank int')}, {S.cte('c', COVERS, 'chunk_id string, gold_id string')}, {S.cte('g', WANTED, 'query_id string, gold_id string')},
    m AS (SELECT query_id, gold_id, (SELECT min(rank) FROM w JOIN c USING (chunk_id) WHERE w.query_id = g.query_id AND c.gold_id = g.gold_id) AS rank FROM g)
    SELECT query_id, count(*) AS n_gold, {', '.join(f"round(count_if(rank <= {k}) / count(*), 9) AS recall_{k}, CASE WHEN count_if(rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}" for k in (1, 3, 5))}, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS mrr, min(rank)::INTEGER AS first_gold_rank FROM m GROUP BY query_id""")
def window_metrics(spark, d):
    return evaluation.window_metrics(spark.createDataFrame(WINDOWS, "query_id string, chunk_id string, rank int"), spark.createDataFrame(COVERS, "chunk_id string, gold_id string"), spark.createDataFrame(WANTED, "query_id string, chunk_id string"))


EVAL_ITEMS = [("q1", "What does Section 8(5) ask of a Data Fiduciary?", "lookup", ["act:s8(5)"], None), ("q6", "What is item 11 of Part B of the First Schedule?", "table", ["rules:sch1:B:11"], None), ("q9", "Tell me about children.", "lookup", [], None)]


@query()
def evaluation_run(spark, d):
    golden = spark.createDataFrame(EVAL_ITEMS, "id string, question string, category string, gold_chunk_ids array<string>, as_of_date date")
    return evaluate.run(S.chunks(spark), None, golden, Settings(mode="bm25", k=3, candidates=10, cross_refs=True), AS_OF)
