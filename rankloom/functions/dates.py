"""Dates in gazette wording, and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and the wording of commencement clauses.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "eighteen": 18, "twenty-four": 24,
}
OFFSET = r"\b([a-z-]+|\d+)\s+(year|month)s?\s+(?:from|after)\s+the\s+date\s+of\s+publication"


def gazette_date(text: Column) -> Column:
    """The first date like "the 13th November, 2025"; null without one."""
    pattern = r"the\s+(\d{1,2})(?:st|nd|rd|th)?\s+([A-Z][a-z]+),?\s+(\d{4})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws(" ", part(1), part(2), part(3)), "d MMMM yyyy"))


def offset_months(text: Column) -> Column:
    """Months after publication that a clause names: "one year", "18 months", on publication 0; else null."""
    quantity = F.regexp_extract(text, OFFSET, 1)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    number = F.coalesce(F.try_element_at(words, quantity), F.expr("null").cast("int"))
    number = F.when(quantity.rlike(r"^\d+$"), quantity.try_cast("int")).otherwise(number)
    months = number * F.when(F.regexp_extract(text, OFFSET, 2) == "year", 12).otherwise(1)
    return F.when(text.rlike(OFFSET), months).when(text.rlike(r"\bdate of (?:their )?publication\b"), F.lit(0))


def in_force(date: Column, as_of: Column) -> Column:
    return F.coalesce(date <= as_of, F.lit(False))


def force_status(date: Column, as_of: Column) -> Column:
    return (
        F.when(date.isNull(), "commencement date unknown")
        .when(date <= as_of, F.concat(F.lit("IN FORCE on "), as_of.cast("string"), F.lit(" (since "), date.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("NOT YET IN FORCE on "), as_of.cast("string"), F.lit(" (comes into force on "), date.cast("string"), F.lit(")")))
    )


def date_number(date: Column) -> Column:
    """yyyymmdd as an integer, as stored beside vectors."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)
