"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit a rule;
policies are versioned masks over those bits, so a verdict, or what dropping a rule would change, needs no text.

Defined results: a null or empty text has no words, measures 0 everywhere and fails only the rules on length
and shape; a very long text is measured whole; values equal to a rule's limit pass; repeated rows, and rows that share an
id, give a row each; an empty table gives an empty result; further columns of the input are ignored, also those named
as the results are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_text, batched, gram_hashes, mixed

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")


@dataclass(frozen=True)
class Rule:
    """A document fails if the condition (Spark and DuckDB SQL over the measurements) holds."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("words_too_short", 4, "word_chars < 2 * n_words"),
    Rule("words_too_long", 5, "word_chars > 15 * n_words"),
    Rule("too_many_words", 6, "n_words > 1000000"),
    Rule("echoed_words", 7, "10 * n_echo_words > 3 * n_words"),
)
#: Version to the rules that it applies. A version is never changed; a new one is added.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "2024-1": ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "words_too_short", "words_too_long", "echoed_words"),
}
BASE, CURRENT = "base", "2024-1"


def mask(version: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[version])


def _by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)


def repeated_words(ids: np.ndarray, bounds: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each text, the words inside a window of k words that the text holds twice or more."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams = gram_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), k)
    if not len(grams):
        return np.zeros(len(bounds) - 1, np.int64)
    whole = owner[: len(grams)] == owner[k - 1 :]
    at = np.flatnonzero(whole)
    keys = grams[at] ^ mixed(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return _by_text(np.cumsum(edge)[:-1] > 0, bounds)


def echoed_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, the words equal to the word before."""
    if not len(ids):
        return np.zeros(len(bounds) - 1, np.int64)
    same = np.concatenate([[False], ids[1:] == ids[:-1]])
    same[bounds[:-1][np.diff(bounds) > 0]] = False
    return _by_text(same, bounds)


def _lines(text: str) -> tuple[int, int]:
    worded = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(worded), len(worded) - len(set(worded))


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts)
    sizes = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False) if len(words.dictionary) else np.zeros(0, np.int64)
    lines = [_lines(t) for t in texts.to_pylist()]
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": _by_text(sizes[words.ids] if len(words.ids) else np.zeros(0, np.int64), words.bounds),
        "n_symbols": sum(pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in SYMBOLS),
        "n_dup_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": repeated_words(words.ids, words.bounds),
        "n_lines": np.array([x[0] for x in lines], np.int64),
        "n_echo_words": echoed_words(words.ids, words.bounds),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, the measurements, and `failures` with bit r set if rule r fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batch: pa.RecordBatch) -> pa.Table:
        m = measured(as_text(batch.column("text")))
        return pa.table([batch.column("id"), *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=["id", *MEASURES])

    out = batched(rows, measure, f"id {kind}, " + ", ".join(f"{k} bigint" for k in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("failures", total).withColumnRenamed("id", id_col)


def passes(version: str) -> Column:
    """The verdict of a policy, from the ledger's bits alone."""
    return F.col("failures").bitwiseAND(F.lit(mask(version)).cast("bigint")) == 0


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would pass without it.

    The ledger is summed by its masked bits first (at most 2 ** rules groups, combined before the shuffle); the
    rules are then read from those few groups.
    """
    held = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(version)).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules)))
    hit = F.col("r.bit").bitwiseAND(F.col("bits")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (
        held.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
