"""The queries of the training-data operators: op1 to op10, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_crf, language_id, licenses, near_dedup, quality_model, quality_rules, sentencepieces, substring_dedup, token_store
from .common import table
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
#: Vocabulary files of public tokenizers are a parameter; they are not part of this repository.
TOKENIZER_DIR = "RANKLOOM_TOKENIZERS"


def tokenizer_file(name: str) -> str:
    if folder := os.environ.get(TOKENIZER_DIR):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.CURRENT).alias("kept"),
        "n_lines", "failures",
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files, for the licence scan: source/lang/doc_id.txt.

    A document that opens or ends with a licence line is a licence file: of its source if it has less than 400 characters,
    else of the folder of its language there.
    """
    opens = F.lower(F.substring_index("text", "\n", 1)).rlike(licenses.HEADER) | F.lower(F.substring_index("text", "\n", -1)).rlike(licenses.HEADER)
    source, lang, name = (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang", "doc_id"))
    path = F.when(opens & (F.char_length("text") < 400), F.concat(source, F.lit("/LICENSE-"), name)).when(opens, F.concat(source, F.lit("/"), lang, F.lit("/LICENSE-"), name)).otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), name, F.lit(".txt")))
    return docs.select("doc_id", "text", path.alias("path"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(as_files(table(spark, sf_dir, "documents")), keep=("doc_id",))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).documents()


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = quality_model.score(docs, quality_model.fit(docs, labels, "quality"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold("doc_id", 3) != 1))
    got = language_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_quality_rules, op3_license_scan, op4_token_store, op5_quality_classifier, op6_language_id, op7_substring_dedup, op8_near_dedup, op9_decontamination, op10_sentencepiece)
}
