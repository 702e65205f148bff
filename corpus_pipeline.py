"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir).

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns pieces of
packed sequences. Defined results of all stages: an empty table passes through; further columns stay as they are, whatever
their names; rows that share an id or have none are judged by their own texts; a text is one row, of any length that fits
a task with its words; bytes that are no UTF-8 are read as replacement characters where characters count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import common, decontamination, language_id, near_duplicates, packing, secrets
from stratalith.llm.queries import tokenizer

#: SQL cannot express the language model and the tokenizer; the tests compare with brute-force versions of the stages.
ORACLE_SQL = None


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the rows outside of the held-out fold teach. Rows with a null
    text or one without a letter go; of repeated rows all stay."""
    return language_id.accepted(docs, language_id.fit(docs, common.folds(F.col("doc_id"), 4) != 2))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the least doc_id (null last), of rows with one doc_id the
    one with the least digest. Texts without words are nobody's copy and stay."""
    return near_duplicates.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage. Null texts and an empty benchmark have none."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind in brackets; ``n_chars`` follows the text. Null texts stay."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; null and empty texts are their end id alone."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", in_known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored as Parquet before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
