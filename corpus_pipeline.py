"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontamination, language_id, near_dedup, queries, sentencepieces, substring_dedup
from rankloom.llm.common import table, written

#: Documents in which no language makes up this share are rejected.
LEAST_SHARE = 1 / 3


#: Put before the columns of documents while an operator runs, so that none clashes with its own.
APART = "in__"


def _apart(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with every column renamed, and the names of those that are neither id nor text."""
    renamed = docs.toDF(*(APART + c for c in docs.columns))
    return renamed, tuple(APART + c for c in docs.columns if c not in ("doc_id", "text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those of which no language makes up a third. Columns stay as they are.

    Null and empty texts go; rows without a language are judged, not learnt from; if no row has a language, all go;
    repeated rows stay or go together; rows with a null id are judged like others.
    """
    model = language_id.fit(docs.where(queries.fold("doc_id", 3) != 1))
    renamed, others = _apart(docs)
    judged = language_id.predict(renamed, model, id_col=APART + "doc_id", text_col=APART + "text", keep=(*others, APART + "text"))
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*(F.col(APART + c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays. Columns stay as they are.

    Texts without words are in no group and stay; rows that share an id are one document and stay or go together; rows
    with a null id stay.
    """
    dropped = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans that occur earlier; a document of which no word is left goes. n_chars is counted anew.

    A null text becomes an empty one; rows with a null id stay whole; rows that share an id lose the same places. All
    other columns stay as they are.
    """
    renamed, others = _apart(docs)
    cut = substring_dedup.remove_repeats(renamed, id_col=APART + "doc_id", text_col=APART + "text", keep=others, with_text=True)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    rest = cut.where("n_words = 0 or n_removed < n_words")
    return rest.select(*(new.get(c, F.col(APART + c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Columns stay as they are.

    Null and empty texts stay; of rows that share an id all go if one holds a window; rows with a null id stay.
    """
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(judged.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip (decoding gives the text again) and ids, a row for each row of docs.

    A null or empty text has no ids; other columns are left behind.
    """
    return sentencepieces.encode(docs.select("doc_id", "text"), queries.tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeated_spans),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]
#: SQL cannot express the mixture, the groups or the pieces; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
