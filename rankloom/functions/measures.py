"""Arithmetic of scores, spans, cost and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length of two half-open spans."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


@dataclass(frozen=True)
class Pricing:
    """Dollars a million tokens; above the threshold of input tokens the long rates hold."""

    input: float
    output: float
    long_context_threshold: int
    long_input: float
    long_output: float
    cache_write_multiplier: float = 1.0
    cache_read_multiplier: float = 1.0


def cost_usd(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, p: Pricing) -> Column:
    is_long = tokens_in + cache_read + cache_write > p.long_context_threshold
    rate = lambda short, long: F.when(is_long, F.lit(long / 1e6)).otherwise(F.lit(short / 1e6))
    priced = tokens_in + cache_write * F.lit(p.cache_write_multiplier) + cache_read * F.lit(p.cache_read_multiplier)
    return priced * rate(p.input, p.long_input) + tokens_out * rate(p.output, p.long_output)


def gate_status(baseline: Column, current: Column, max_drop: Column, tolerance: Column) -> Column:
    """new, missing, fail, improved or pass; higher is better."""
    drop = baseline - current
    return (
        F.when(baseline.isNull(), "new")
        .when(current.isNull(), "missing")
        .when(drop > max_drop + tolerance + F.lit(1e-12), "fail")
        .when(drop < F.lit(-1e-12), "improved")
        .otherwise("pass")
    )


def provision_label(section: Column, sub_section: Column, clause: Column) -> Column:
    """section 9(1)(a)"""
    part = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit("("), c, F.lit(")"))).otherwise("")
    return F.concat(F.lit("section "), section, part(sub_section), part(clause))
