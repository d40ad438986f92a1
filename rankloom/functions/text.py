"""String functions as columns. Regular expressions are Java's; `(?U)` makes \\s and \\w cover Unicode."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ranking ignores.
STOPWORDS = (
    "a an and are as at be by for from has in is it its of on or such that the this to under was which with shall any may"
).split()
CURLY, STRAIGHT = "“”‘’", "\"\"''"
# Characters of prompt markup and their references; & comes first.
MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
QUOTES = (('"', "&quot;"), ("'", "&#x27;"))


def tokens(text: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Lower-case runs of a-z and 0-9 without the stopwords; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stopwords))) if stopwords else found


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, CURLY, STRAIGHT)


def escaped(text: Column, quotes: bool = False) -> Column:
    """& < > (and quotes) as character references."""
    pairs = MARKUP + (QUOTES if quotes else ())
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def rendered(title: Column, text: Column, max_chars: int | None = None) -> Column:
    """What is indexed of a chunk: title, line feed, text; stripped and perhaps cut."""
    out = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.substring(out, 1, max_chars) if max_chars else out


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, in any case."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def literal_pattern(text: Column) -> Column:
    """A regular expression for the text itself that does not start or end inside a word."""
    edge = lambda c, mark: F.when(c.rlike(r"(?U)^[\p{L}\p{N}]$"), F.lit(mark)).otherwise(F.lit(""))
    return F.concat(edge(F.substring(text, 1, 1), r"(?<!\w)"), F.lit("\\Q"), text, F.lit("\\E"), edge(F.substring(text, -1, 1), r"(?!\w)"))


def joined_cell(text: Column) -> Column:
    """Lines of a wrapped cell joined by a space, or by nothing after a hyphen."""
    parts = F.filter(F.transform(F.split(text, r"\R"), squash), lambda p: p != "")
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.concat(acc, F.when((acc == "") | acc.endswith("-"), "").otherwise(" "), p))


def mentions(text: Column) -> Column:
    """Sections and rules named in a text: array of (kind, number, sub), the first of equals, in order."""
    pattern = r"(?i)\b(section|rule)s?\s+(\d+[A-Z]?)(?:\s*\(\s*(\w+)\s*\))?"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("kind"), part(2).alias("number"), part(3).alias("sub"))
    return F.array_distinct(F.transform(zipped, lambda m: F.struct(F.lower(m["kind"]).alias("kind"), F.upper(m["number"]).alias("number"), F.when(m["sub"] != "", F.lower(m["sub"])).alias("sub"))))


def rule_numbers(text: Column) -> Column:
    """Numbers in "rules 3, 5 to 7, 22 and 23", ranges filled in; a falling range has its first number only."""
    runs = F.regexp_extract_all(text, F.lit(r"\b[Rr]ules?\s+(\d+(?:\s*(?:,|and|to)\s*\d+)*)"), F.lit(1))
    ranges = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"\d+(?:\s*to\s*\d+)*"), F.lit(0))))

    def filled(r: Column) -> Column:
        ends = F.transform(F.split(r, r"\s*to\s*"), lambda x: x.cast("int"))
        steps = F.transform(
            ends,
            lambda x, i: F.when(i == 0, F.array(x)).when(x > ends[i - 1], F.sequence(ends[i - 1] + 1, x)).otherwise(F.array().cast("array<int>")),
        )
        return F.flatten(steps)

    return F.transform(F.flatten(F.transform(ranges, filled)), lambda n: n.cast("string"))


def hash_dimension(token: Column, dim: int) -> Column:
    """Where a token counts in a hash embedding: the first four bytes of its MD5, little-endian, modulo dim."""
    m = F.md5(token)
    swapped = functools.reduce(operator.add, [[F.substring(m, i, 2)] for i in (7, 5, 3, 1)])
    return (F.conv(F.concat(*swapped), 16, 10).cast("bigint") % dim).cast("int")


#: Signs that set matches apart while a text is cut up; private-use characters, taken out of texts first.
_FROM, _TO = "\ue000", "\ue001"


def matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern: array of (start, end, match, gap), gap being the text up to the next match."""
    plain = F.translate(F.coalesce(text, F.lit("")), _FROM + _TO, "")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_FROM}$1{_TO}"), _FROM)
    kind = "struct<at:int,out:array<struct<start:int,end:int,match:string,gap:string>>>"
    begin = F.struct(F.char_length(parts[0]).alias("at"), F.array().alias("out")).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        match, gap = F.substring_index(part, _TO, 1), F.substring_index(part, _TO, -1)
        end = acc["at"] + F.char_length(match)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), match.alias("match"), gap.alias("gap"))
        return F.struct((end + F.char_length(gap)).alias("at"), F.concat(acc["out"], F.array(found)).alias("out")).cast(kind)

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, step)["out"]
