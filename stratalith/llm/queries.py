"""The queries op1 to op13 and pipeline, with SQL where it can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    conversation_repair,
    decontamination,
    language_id,
    near_duplicates,
    packing,
    personal_data,
    projection_forest,
    quality_model,
    quality_rules,
    secrets,
    token_files,
    whitening,
)
from .common import folds, table
from .oracle import MARKS, ORACLE_SQL  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.judged(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[-1])
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE.mask).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which every machine has at the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), marks_as_text=False)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{MARKS}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = chat_format.read_back(chat_format.formatted(turns.unionByName(added)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["number"] < sum(r.base for r in secrets.RULES))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "row.doc_id", *[number(r.kind) for r in secrets.RULES if r.base], F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, folds(F.col("doc_id"), 4) != 2)
    return language_id.predictions(docs, model).select("doc_id", (folds(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = quality_model.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), folds(F.col("doc_id"), 5) != 0)
    return quality_model.scores(docs, *fitted).select("doc_id", (folds(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = personal_data.personal_data(docs, personal_data.fit(docs))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(number, personal_data.KINDS), F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    per_component = whitening.whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return per_component.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened",
        F.element_at(F.lit(model.explained.tolist()).cast("array<double>"), F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.filled(table(spark, sf_dir, "conversations"))
    return conversation_repair.reports(conversation_repair.damaged(rows), rows)


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the policy and each of its rules: documents that fail it, and that fail nothing else of it."""
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    rows = reduce(DataFrame.unionByName, [quality_rules.ablations(book, p) for p in quality_rules.POLICIES])
    return rows.select("policy", "rule", "failing", "failing_alone", "documents")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 with proximity matches: all words of a window within two places of theirs."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    return found.select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("items"), "contaminated")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_secret_scans": op9_secret_scans,
    "op10_personal_data": op10_personal_data,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_conversation_repair": op13_conversation_repair,
    "rule_ablations": rule_ablations,
    "benchmark_proximity": benchmark_proximity,
}
