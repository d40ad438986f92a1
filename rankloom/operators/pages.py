"""Printed pages from a table of text spans: what is body, what is noise, and lines.

Spans (page_id, text, x0, y0, x1, y1, size, color, slope) are what any reader of printed pages gives; tables (page_id, x0,
y0, x1, y1) and rules (page_id, x0, y0, x1, y1) are the boxes of tables and of drawn lines on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash
from .segments import line_groups, watermark_fragments


@dataclass(frozen=True)
class PageSettings:
    """Bands, sizes and colours of a document's print."""

    header_max_y: float = 0.0
    footer_min_y: float = 1e9
    min_font_size: float = 0.0
    watermark_words: tuple[str, ...] = ()
    watermark_colors: tuple[int, ...] = ()
    fragment_max_len: int = 2
    footer_patterns: tuple[str, ...] = ()
    editorial_patterns: tuple[str, ...] = ()
    footnote_rule_max_width: float = 0.0
    page_height: float = 842.0


def _centred(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.expr(f"(s.x0 + s.x1) / 2 between {x0} and {x1} and (s.y0 + s.y1) / 2 between {y0} and {y1}")


def printed_numbers(spans: DataFrame, s: PageSettings) -> DataFrame:
    """(page_id, page): the last number of up to three digits in a page's header or footer band."""
    band = (F.col("y1") <= s.header_max_y) | (F.col("y0") >= s.footer_min_y)
    n = F.trim("text")
    return spans.where(band & n.rlike(r"^\d{1,3}$")).groupBy("page_id").agg(F.max_by(n.cast("int"), F.struct("y0", "x0")).alias("page"))


def body_spans(spans: DataFrame, s: PageSettings, tables: DataFrame | None = None, rules: DataFrame | None = None, clip: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Spans that are text of the body: upright, not of a watermark's colour or words, outside the bands, no footnote or
    its mark, not centred in a table, and centred inside `clip`."""
    t = F.trim("text")
    mark = F.col("text").isNull() | (F.col("text") == "") | (F.abs("slope") > 0.01) | F.col("color").isin(list(s.watermark_colors)) | t.isin(list(s.watermark_words))
    band = (F.col("y1") <= s.header_max_y) | (F.col("y0") >= s.footer_min_y)
    note = (F.col("size") < s.min_font_size) & t.rlike(r"^[\d*]+$")
    out = spans.where(~F.coalesce(mark, F.lit(False)) & ~band & ~note)
    if rules is not None and s.footnote_rule_max_width:
        short = rules.where((F.col("y1") - F.col("y0") < 2) & (F.col("x1") - F.col("x0") > 50) & (F.col("x1") - F.col("x0") < s.footnote_rule_max_width) & (F.col("y0") > s.page_height / 2) & (F.col("x0") < 80))
        out = out.join(short.groupBy("page_id").agg(F.min("y0").alias("__foot")), "page_id", "left").where("__foot is null or y0 < __foot").drop("__foot")
    if tables is not None:
        box = tables.select(F.col("page_id").alias("__page"), *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
        out = out.alias("s").join(box, (F.col("s.page_id") == F.col("__page")) & _centred("t_x0", "t_y0", "t_x1", "t_y1"), "left_anti")
    if clip is not None:
        out = out.alias("s").where(_centred(*(repr(float(clip[i])) for i in range(4))))
    return out


def read_page_spans(spans: DataFrame, s: PageSettings, tables: DataFrame | None = None, rules: DataFrame | None = None, clip: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(page_id, page, line_no, text, x0, y): the lines of the body, without watermark pieces, editors' marks and footers,
    numbered from 1 on each page."""
    body = body_spans(spans, s, tables, rules, clip)
    lines = line_groups(body.select("page_id", "text", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y")))
    text = F.col("text")
    for p in s.editorial_patterns:
        text = F.regexp_replace(text, p, "")
    lines = lines.withColumn("text", F.rtrim(text))
    t = squash(F.col("text"))
    noise = (t == "") | (t.rlike(r"^\p{L}+$") & t.isin(watermark_fragments(list(s.watermark_words), s.fragment_max_len)))
    for p in s.footer_patterns:
        noise = noise | t.rlike(p)
    kept = lines.where(~noise).withColumn("line_no", F.row_number().over(Window.partitionBy("page_id").orderBy("line_no")))
    return kept.join(printed_numbers(spans, s), "page_id", "left").select("page_id", "page", "line_no", "text", "x0", "y")
