"""Fixed schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _type(name: str) -> T.DataType:
    return T.ArrayType(_type(name[6:-1])) if name.startswith("array<") else _TYPES[name]


def _struct(spec: str) -> T.StructType:
    """A schema without a session, as the module is imported before there is one."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (c.split() for c in spec.split(","))])


CHUNK = _struct(
    "chunk_id string, doc_id string, doc_type string, gsr_no string, title string, chapter string, chapter_title string,"
    " section string, sub_section string, clause string, rule string, sub_rule string, schedule string, part string, item string,"
    " illustration boolean, cases array<string>, lead_in string, page int, page_end int, text string, in_force_date date,"
    " refers_to array<string>, refers_to_provisions array<string>, penalty string, text_original string, text_corrected string,"
    " corrected_by string, corrects array<string>, see_rules array<string>, source_file string"
)
GOLDEN = _struct(
    "id string, question string, category string, gold_chunk_ids array<string>, reference_answer string, answerable boolean,"
    " as_of_date date, author string"
)
REQUEST = _struct(
    "id bigint, timestamp timestamp, config_hash string, latency_ms double, tokens_in bigint, tokens_out bigint,"
    " cost_usd double, cached int, refused int, source string"
)
RANKING = _struct("query_id string, stage string, list_idx int, rank int, chunk_id string, score double")
LINE = _struct("doc_id string, pdf_page int, page int, line_no int, text string, x0 double, y0 double, ord bigint")
TABLE = _struct("doc_id string, pdf_page int, page int, y0 double, rows array<array<string>>")
PATCH = _struct(
    "item string, page int, line int, line_end int, old_text string, new_text string, kind string, source_text string"
)
KV = _struct("key string, value string, ts timestamp")
DOC_TYPES = ("act", "rules", "notification", "corrigendum")
REQUEST_SOURCES = ("api", "eval")
